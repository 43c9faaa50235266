"""Inconsistency: schema checks, constraint files and patterns, compiled to predicates; and their discovery."""

from __future__ import annotations

import json
import logging
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.functions.stats import number
from sievelake.operators.base import Action, DataValidationError

log = logging.getLogger(__name__)

#: Check names to predicates over (column, argument).
CHECKS = {
    "ge": lambda x, a: x >= F.lit(a), "greater_than_or_equal_to": lambda x, a: x >= F.lit(a),
    "gt": lambda x, a: x > F.lit(a), "greater_than": lambda x, a: x > F.lit(a),
    "le": lambda x, a: x <= F.lit(a), "less_than_or_equal_to": lambda x, a: x <= F.lit(a),
    "lt": lambda x, a: x < F.lit(a), "less_than": lambda x, a: x < F.lit(a),
    "eq": lambda x, a: x == F.lit(a), "equal_to": lambda x, a: x == F.lit(a),
    "ne": lambda x, a: x != F.lit(a), "not_equal_to": lambda x, a: x != F.lit(a),
    "isin": lambda x, a: x.isin(list(a)), "notin": lambda x, a: ~x.isin(list(a)),
    "in_range": lambda x, a: x.between(*((a["min_value"], a["max_value"]) if isinstance(a, dict) else a)),
    "str_matches": lambda x, a: x.cast("string").rlike(f"^(?:{a})"), "regex": lambda x, a: x.cast("string").rlike(f"^(?:{a})"),
    "str_contains": lambda x, a: x.cast("string").rlike(a),
    "str_startswith": lambda x, a: F.startswith(x.cast("string"), F.lit(a)), "str_endswith": lambda x, a: F.endswith(x.cast("string"), F.lit(a)),
    "str_length": lambda x, a: F.length(x.cast("string")).between(*((a.get("min_value", 0), a.get("max_value", 1 << 30)) if isinstance(a, dict) else a)),
}
DTYPES = {"int": "bigint", "int64": "bigint", "int32": "int", "float": "double", "float64": "double", "float32": "float", "str": "string", "string": "string", "object": "string", "bool": "boolean", "datetime64[ns]": "timestamp", "datetime": "timestamp"}


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


class SchemaValidator(Action):
    """schema_config = {"columns": {name: {dtype, nullable=False, required=True, checks={name: argument}, unique}}}.

    A value passes if it casts to its type, is not null unless nullable, and meets every check; nulls meet checks. A missing
    required column or an unknown check drops no row and is logged.
    """

    DEFAULTS = {"schema_config": {"columns": {}}, "remove_inconsistent_rows": True, "strict": False}

    def predicates(self, df: DataFrame) -> dict[str, Column]:
        out = {}
        for name, config in (self.params["schema_config"] or {}).get("columns", {}).items():
            config = dict(config or {})
            if name not in df.columns:
                if config.get("required", True):
                    log.warning("column %s is missing", name)
                continue
            x = F.col(f"`{name}`")
            if dtype := config.get("dtype"):
                cast = x.try_cast(DTYPES.get(str(dtype), str(dtype)))
                out[f"{name}:dtype"] = x.isNull() | cast.isNotNull()
                x = cast
            if not config.get("nullable", False):
                out[f"{name}:nullable"] = x.isNotNull()
            for check, argument in (config.get("checks") or {}).items():
                if check not in CHECKS:
                    log.warning("check %s is unknown; column %s goes unchecked by it", check, name)
                    continue
                out[f"{name}:{check}"] = F.coalesce(CHECKS[check](x, argument), F.lit(True))
        return out

    def violations(self, df: DataFrame) -> DataFrame:
        """A row per check: how many rows fail it."""
        found = self.predicates(df)
        if not found:
            return df.sparkSession.createDataFrame([], "check string, failed long")
        row = df.agg(*(F.count(F.when(~p, 1)).alias(str(i)) for i, p in enumerate(found.values())))
        return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(str(i)).alias("failed")) for i, k in enumerate(found)))).alias("v")).select("v.*")

    def apply(self, df, columns, stats):
        found = self.predicates(df)
        if self.params["strict"]:
            bad = df.where(~all_of(list(found.values()))).limit(1).count()
            if bad:
                raise DataValidationError(f"{self.name}: rows break the schema")
            return df
        if not self.params["remove_inconsistent_rows"]:
            log.warning("rows that break the schema are kept")
            return df
        return df.where(all_of(list(found.values())))


PanderaSchemaValidator = SchemaValidator


class Validated(Action):
    """An operator whose results are held against a schema: `strict` raises DataValidationError where a row breaks it, `warn` logs how
    many do for each check and hands the rows on, `off` does not look."""

    def __init__(self, action: Action, schema_config: dict[str, Any], mode: str = "strict", **params):
        super().__init__(name=params.pop("name", f"validated {action.name}"), **params)
        if mode not in ("strict", "warn", "off"):
            raise ValueError("mode is strict, warn or off")
        self.action, self.mode, self.validator = action, mode, SchemaValidator(schema_config=schema_config)

    def fit(self, df):
        self.action.fit(df)
        self.fitted_columns, self.stats = self.action.fitted_columns, self.action.stats
        return self

    def transform(self, df):
        out = self.action.transform(df)
        if self.mode == "off":
            return out
        broken = {r.check: r.failed for r in self.validator.violations(out).collect() if r.failed}  # a row a check
        if broken and self.mode == "strict":
            raise DataValidationError(f"{self.action.name}: rows break {', '.join(sorted(broken))}")
        for check, n in sorted(broken.items()):
            log.warning("%s: %d rows break %s", self.action.name, n, check)
        return out


def constraint_predicates(df: DataFrame, fields: dict[str, dict[str, Any]]) -> list[Column]:
    """Row predicates of a constraint file's fields; nulls pass all but max_nulls = 0."""
    out = []
    for name, rule in fields.items():
        if name not in df.columns:
            continue
        x = F.col(f"`{name}`")
        size = F.length(x.cast("string"))
        made = []
        if rule.get("min") is not None:
            made.append(x >= F.lit(rule["min"]))
        if rule.get("max") is not None:
            made.append(x <= F.lit(rule["max"]))
        if rule.get("min_length") is not None:
            made.append(size >= rule["min_length"])
        if rule.get("max_length") is not None:
            made.append(size <= rule["max_length"])
        if rule.get("sign"):
            made.append({"positive": x > 0, "non-negative": x >= 0, "zero": x == 0, "non-positive": x <= 0, "negative": x < 0}[rule["sign"]])
        if rule.get("allowed_values"):
            made.append(x.isin(list(rule["allowed_values"])))
        if rule.get("rex"):
            made.append(reduce(lambda a, b: a | b, (x.cast("string").rlike(r) for r in rule["rex"])))
        out += [F.coalesce(p, F.lit(True)) for p in made]
        if rule.get("max_nulls") == 0:
            out.append(x.isNotNull())
    return out


class ConstraintChecker(Action):
    """Drops rows that break any constraint of a JSON file ({"fields": ...}) or a dict; if all rows would go, all stay."""

    DEFAULTS = {"constraints": None, "file_name": None}

    def apply(self, df, columns, stats):
        rules = self.params["constraints"] or json.loads(open(self.params["file_name"]).read())
        kept = df.where(all_of(constraint_predicates(df, rules["fields"])))
        return kept if kept.limit(1).count() else df


class PatternChecker(Action):
    """Keeps rows whose value of each listed column matches any of its patterns; nulls pass. patterns: {column: [regex]}."""

    DEFAULTS = {"patterns": {}, "file_name": None}

    def patterns(self) -> dict[str, list[str]]:
        if not self.params["file_name"]:
            return self.params["patterns"]
        out: dict[str, list[str]] = {}
        for line in open(self.params["file_name"]).read().splitlines():
            parts = line.split(";", 2)
            if len(parts) == 3 and parts[1].strip().lstrip("-").isdigit():
                out.setdefault(parts[0].strip(), []).append(parts[2].strip())
        return out

    def apply(self, df, columns, stats):
        tests = [F.coalesce(reduce(lambda a, b: a | b, (F.col(f"`{c}`").cast("string").rlike(p) for p in own)), F.lit(True)) for c, own in self.patterns().items() if c in df.columns and own]
        return df.where(all_of(tests))


def discover_constraints(df: DataFrame, most_values: int = 20) -> dict[str, dict[str, dict[str, Any]]]:
    """Type, bounds, lengths, nulls, sign and the allowed values of columns with at most `most_values`: one pass, then one for the value sets."""
    kinds = {f.name: "real" if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)) else "int" if isinstance(f.dataType, T.NumericType) else "bool" if isinstance(f.dataType, T.BooleanType) else "date" if isinstance(f.dataType, (T.DateType, T.TimestampType)) else "string" for f in df.schema.fields}
    exprs = []
    for c, kind in kinds.items():
        x = F.col(f"`{c}`")
        exprs += [F.count(F.when(x.isNull(), 1)).alias(f"nulls_{c}"), F.approx_count_distinct(x).alias(f"distinct_{c}")]
        exprs += [F.min(F.length(x)).alias(f"min_{c}"), F.max(F.length(x)).alias(f"max_{c}")] if kind == "string" else [F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}")]
    row = df.agg(*exprs).first()
    few = [c for c, k in kinds.items() if k == "string" and 0 < row[f"distinct_{c}"] <= 2 * most_values]
    values = df.agg(*(F.sort_array(F.collect_set(F.col(f"`{c}`"))).alias(c) for c in few)).first() if few else {}
    fields = {}
    for c, kind in kinds.items():
        low, high = row[f"min_{c}"], row[f"max_{c}"]
        own: dict[str, Any] = {"type": kind}
        if kind == "string":
            own |= {"min_length": low, "max_length": high}
            if c in few and len(values[c]) <= most_values:
                own["allowed_values"] = values[c]
        elif low is not None:
            own |= {"min": low, "max": high}
            if kind in ("int", "real"):
                own["sign"] = "positive" if low > 0 else "zero" if low == high == 0 else "non-negative" if low >= 0 else "negative" if high < 0 else "non-positive" if high <= 0 else None
        if not row[f"nulls_{c}"]:
            own["max_nulls"] = 0
        fields[c] = {k: v for k, v in own.items() if v is not None}
    return {"fields": fields}


def shape_of(x: Column) -> Column:
    """Letters and digits to classes A, a and 9, other signs as they are."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x.cast("string"), "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "9")


def discover_patterns(df: DataFrame, column: str, most: int = 20) -> list[str]:
    """Regular expressions of the column's most frequent shapes, runs as ranges of length."""
    shapes = [r[0] for r in df.where(F.col(column).isNotNull()).groupBy(F.regexp_replace(shape_of(F.col(column)), r"(.)\1+", "$1+").alias("s")).count().orderBy(F.desc("count"), "s").limit(most).collect()]
    names = {"A": "[A-Z]", "a": "[a-z]", "9": "[0-9]"}
    out = []
    for s in shapes:
        parts = re.findall(r"(.)(\+?)", s, re.S)
        out.append("^" + "".join(names.get(c, re.escape(c)) + ("+" if more else "") for c, more in parts) + "$")
    return out


class MislabelRemover(Action):
    """Drops rows whose out-of-fold logistic prediction differs from the label with confidence over `confidence`."""

    DEFAULTS = {"folds": 3, "confidence": 0.7, "key": None, "least": 40, "keep": 20, "seed": 42}
    NUMERIC_ONLY = True

    def fit(self, df):
        self.fitted_columns, self.stats = [c for c in self.select_columns(df) if c != self.params["key"]], {}
        return self

    def apply(self, df, columns, stats):
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        if df.limit(self.params["least"]).count() < self.params["least"]:
            return df
        key, k = self.params["key"], self.params["folds"]
        own = df.withColumns({f"_x_{c}": F.coalesce(number(c), F.lit(0.0)) for c in columns}).withColumn("_y", F.col(self.target).cast("double"))
        rows = VectorAssembler(inputCols=[f"_x_{c}" for c in columns], outputCol="_x").transform(own).select(key, "_x", "_y").withColumn("_fold", F.pmod(F.xxhash64(key, F.lit(self.params["seed"])), F.lit(k)))
        bad = None
        for fold in range(k):
            model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=0.01).fit(rows.where(F.col("_fold") != fold))
            scored = model.transform(rows.where(F.col("_fold") == fold)).where((F.col("prediction") != F.col("_y")) & (F.array_max(vector_to_array("probability")) > self.params["confidence"])).select(F.col(key).alias("_bad"))
            bad = scored if bad is None else bad.unionByName(scored)
        kept = df.join(bad, df[key] == bad["_bad"], "left_anti")
        return kept if kept.limit(self.params["keep"]).count() >= self.params["keep"] else df
