"""Names under which operators, distances, sources, evaluators and rewards are asked for, with their usual parameters."""

from __future__ import annotations

from typing import Any

from sievelake.operators import base, crossval, dedup, distance, evaluate, impute, outliers, scale, select, splines, validate
from sievelake.sources import loaders

# Public names and the usual parameters that go with them.
ACTIONS: dict[str, tuple[type, dict[str, Any]]] = {
    "deduplication/exact": (dedup.ExactDeduplicator, {"keep": "first"}),
    "deduplication/approximate": (dedup.ApproximateDeduplicator, {"threshold": 0.95, "comparison_type": "jarowinkler", "keep": "first", "max_rows_limit": 10000}),
    "deduplication/jaccard": (dedup.JaccardSimilarityDeduplicator, {"threshold": 0.8, "num_perm": 128, "combine_columns": True, "keep": "first"}),
    "imputation/em": (impute.EMImputer, {"max_iter": 20, "tol": 1e-3, "random_state": None}),
    "imputation/mice": (impute.MICEImputer, {"random_state": 42}),
    "imputation/knn": (impute.KNNImputer, {"n_neighbors": 5, "weights": "uniform", "metric": "nan_euclidean"}),
    "imputation/mf": (impute.MFImputer, {}),
    "imputation/mean": (impute.MeanImputer, {}),
    "imputation/median": (impute.MedianImputer, {}),
    "imputation/random": (impute.RandomImputer, {"random_state": None}),
    "inconsistency_detection/pandera": (validate.SchemaValidator, {"remove_inconsistent_rows": True, "schema_config": {"columns": {}}}),
    "outlier_detection/iqr": (outliers.IQROutlierCleaner, {"factor": 1.5, "method": "mask"}),
    "outlier_detection/lof": (outliers.LocalOutlierFactorCleaner, {"n_neighbors": 20, "contamination": "auto", "method": "mask"}),
    "outlier_detection/z_score": (outliers.ZScoreOutlierCleaner, {"threshold": 3.0, "method": "mask"}),
    "feature_selection/chi_square": (select.ChiSquareSelector, {"k": 10}),
    "feature_selection/linear_correlation": (select.LinearCorrelationSelector, {"k": 10}),
    "feature_selection/mutual_info": (select.MutualInformationSelector, {"k": 10, "random_state": 42, "n_neighbors": 3}),
    "feature_selection/random_forest": (select.RandomForestSelector, {"n_estimators": 100, "threshold": "median", "max_features": None, "random_state": 42}),
    "feature_selection/variance_threshold": (select.VarianceThresholdSelector, {"threshold": 0.0}),
    "scaling/decimal": (scale.DecimalScaler, {}),
    "scaling/min_max": (scale.MinMaxScaler, {}),
    "scaling/log10": (scale.Log10Scaler, {"shift_epsilon": 1e-6}),
    "scaling/quantile": (scale.QuantileScaler, {"n_quantiles": 1000, "output_distribution": "uniform", "ignore_implicit_zeros": False, "subsample": 100000, "random_state": None}),
    "scaling/z_score": (scale.ZScoreScaler, {"with_mean": True, "with_std": True}),
    "dummy/add": (base.DummyAdd, {"increment": 1}),
}
DISTANCES = distance.DISTANCES
DATASETS = {"csv": loaders.CSVLoader, "hf": loaders.LocalDatasetLoader, "kaggle": loaders.DownloadedCSVLoader, "openml": loaders.CachedTableLoader}
EVALUATORS = {"CART": evaluate.CARTEvaluator, "LDA": evaluate.LDAEvaluator, "NB": evaluate.GaussianNBEvaluator, "MNB": evaluate.MultinomialNBEvaluator, "OLS": evaluate.OLSEvaluator, "LASSO": evaluate.LassoEvaluator, "KMEANS": evaluate.KMeansEvaluator, "HCA": evaluate.AgglomerativeEvaluator, "MARS": splines.MARSEvaluator, "KRR": crossval.KernelRidgeEvaluator}

#: Strategy strings of the dict-of-frames interface.
STRATEGIES: dict[str, dict[str, tuple[type, dict[str, Any]]]] = {
    "imputation": {"EM": (impute.EMImputer, {}), "MICE": (impute.MICEImputer, {}), "KNN": (impute.KNNImputer, {"n_neighbors": 4}), "RAND": (impute.RandomImputer, {}), "MF": (impute.MFImputer, {}), "MEAN": (impute.MeanImputer, {}), "MEDIAN": (impute.MedianImputer, {}), "DROP": (impute.DropMissing, {})},
    "normalisation": {"ZS": (scale.ZScoreScaler, {}), "MM": (scale.MinMaxScaler, {}), "DS": (scale.QuantileScaler, {"n_quantiles": 10}), "Log10": (scale.Log10Scaler, {})},
    "outliers": {"ZSB": (outliers.FractionOutlierCleaner, {"detector": "robust"}), "IQR": (outliers.FractionOutlierCleaner, {"detector": "iqr"}), "LOF": (outliers.MultivariateLOFCleaner, {"n_neighbors": 4, "contamination": 0.1})},
    "duplicates": {"ED": (dedup.ExactDeduplicator, {}), "AD": (dedup.JaccardSimilarityDeduplicator, {"threshold": 0.6, "keep": False}), "METRIC": (dedup.RowStringDeduplicator, {"threshold": 0.6, "metric": "DL"})},
    "consistency": {"CC": (validate.ConstraintChecker, {}), "PC": (validate.PatternChecker, {})},
    "features": {"MR": (select.MissingRatioSelector, {}), "LC": (select.CollinearitySelector, {}), "VAR": (select.LowDeviationSelector, {}), "L1": (select.LassoSelector, {}), "IMP": (select.RandomForestSelector, {"n_estimators": 50, "task": "regression"}), "Tree": (select.ExtraTreesSelector, {"n_estimators": 50}), "WR": (select.ChiSquareSelector, {"k": "all"}), "SVC": (select.LinearSVCSelector, {"C": 0.01})},
}


def action(name: str, **params: Any) -> base.Action:
    kind, usual = ACTIONS[name]
    return kind(**(usual | params))


def strategy(family: str, name: str, **params: Any) -> base.Action:
    kind, usual = STRATEGIES[family][name]
    return kind(name=name, **(usual | params))


def apply_to_dataset(family: str, name: str, dataset: dict[str, Any], **params: Any) -> dict[str, Any]:
    """The dict interface: {'train': ..., 'test': ...}; each part is prepared by an operator fitted on the training part."""
    own = strategy(family, name, **params)
    train = own.fit_transform(dataset["train"])
    test = dataset.get("test")
    return dataset | {"train": train, "test": own.transform(test) if test is not None else None}
