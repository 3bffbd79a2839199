"""Preparation: cleaning, feature groups, calendar parts, learned fills, scaling and one-hot encoding."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator, Transformer
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window, functions as F

from gaugewell.errors import AuditError
from gaugewell.functions import cells, dates, names
from gaugewell.functions.small import small_table
from gaugewell.operators import facts as facts_mod, stats
from gaugewell.operators.schema import columns_of, resolve_target

INFREQUENT = "infrequent"
MAX_ENCODED = 100_000  # categories that may become vector slots and travel with the model


def clean_infinite(df: DataFrame) -> DataFrame:
    """Infinities and NaN of numeric columns become missing."""
    return df.select(*[cells.json_safe(f.name, f.dataType) for f in df.schema.fields])


def clean_target(df: DataFrame, target: str) -> DataFrame:
    """Drop rows whose target is missing or infinite."""
    return clean_infinite(df).where(cells.qcol(resolve_target(df, target)).isNotNull())


@dataclass
class FeatureGroups:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    unsupported: list[str] = field(default_factory=list)
    ids_dropped: list[str] = field(default_factory=list)
    high_cardinality_dropped: list[str] = field(default_factory=list)

    @property
    def dropped(self) -> list[str]:
        return sorted(set(self.ids_dropped + self.high_cardinality_dropped))


def feature_table(
    df: DataFrame, target: str, drop_ids: bool = True, drop_high_cardinality: bool = False, id_unique: float = 95.0,
    cardinality: int = 50, date_rate: float = 0.8,
) -> DataFrame:
    """(position, column, dtype, feature_group, is_id_like, is_high_cardinality, is_date).

    Booleans count as categorical here. A string column is a date when its
    non-blank cells parse at `date_rate`; the date parser only accepts cells of
    a date shape.
    """
    features = [c.name for c in columns_of(df) if c.name != target]
    table = facts_mod.gather(df, target, {"frequency", "dates"}, features).table
    unique = F.col("n_distinct") * 100.0 / F.col("n_rows")
    string = F.col("type_group") == "categorical"
    by_value = string & (unique >= id_unique) & (F.col("n_distinct") > 1)
    is_date = (F.col("type_group") == "datetime") | (
        string & (F.col("n_nonblank") > 0) & (F.col("n_parsed") / F.col("n_nonblank") >= date_rate))
    table = table.withColumns({
        "is_id_like": F.coalesce(names.looks_like_id(F.col("column"), names.ID_WORDS_PREP) | by_value, F.lit(False)),
        "is_high_cardinality": F.coalesce(string & (F.col("n_distinct") >= cardinality), F.lit(False)),
        "is_date": F.coalesce(is_date, F.lit(False)),
        "name_suggests_date": names.looks_like_date(F.col("column")),
    })
    group = (
        F.when(F.lit(drop_ids) & F.col("is_id_like"), "id_like")
        .when(F.lit(drop_high_cardinality) & F.col("is_high_cardinality"), "high_cardinality")
        .when(F.col("is_date"), "datetime")
        .when(F.col("type_group") == "boolean", "categorical").otherwise(F.col("type_group"))
    )
    return table.select("position", "column", "dtype", group.alias("feature_group"), "is_id_like",
                        "is_high_cardinality", "is_date", "name_suggests_date")


def feature_groups(df: DataFrame, target: str, **options) -> FeatureGroups:
    out = FeatureGroups()
    slots = {
        "numeric": out.numeric, "categorical": out.categorical, "datetime": out.datetime,
        "unsupported": out.unsupported, "id_like": out.ids_dropped, "high_cardinality": out.high_cardinality_dropped,
    }
    for r in feature_table(df, target, **options).collect():
        slots[r["feature_group"]].append(r["column"])
    return out


def split_features(df: DataFrame, target: str, groups: FeatureGroups | None = None, keep: list[str] = ()) -> DataFrame:
    """Clean rows with the target first and without dropped columns; `keep` names columns to carry along."""
    target = resolve_target(df, target)
    cleaned = clean_target(df, target)
    if cleaned.isEmpty():
        raise AuditError("No row has a target.")
    groups = groups or feature_groups(cleaned, target)
    gone = set(groups.dropped) - set(keep)
    left = [n for n in df.columns if n != target and n not in gone]
    if not left:
        raise AuditError("No feature column is left.")
    return cleaned.select(*[cells.qcol(n) for n in [target, *left]])


def _timestamp(df: DataFrame, name: str):
    dtype = df.schema[name].dataType
    return dates.parse_date(cells.qcol(name)) if cells.type_group(dtype) == "categorical" else cells.qcol(name).cast("timestamp")


def calendar_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add year, month, day, dayofweek, quarter and month-edge columns for each datetime column."""
    parts = [p for n in columns for p in dates.calendar_parts(n, _timestamp(df, n))]
    return df.select("*", *parts)


def learn_numeric(df: DataFrame, columns: list[str], strategy: str = "median", constant: float = 0.0) -> DataFrame:
    """(column, fill, mean, scale) of numeric columns after filling; scale is the population deviation, 1 when it is 0."""
    if not columns:
        return small_table(df.sparkSession, [], {"column": "string", "fill": "double", "mean": "double", "scale": "double"})
    infos = columns_of(df, columns)
    fills: dict[str, float] = {n: constant for n in columns}
    if strategy == "median":
        fills |= {n: q[0] for n, q in stats.quantiles_of(df, columns, [0.5]).items() if q[0] is not None}
    elif strategy == "mean":
        _, found = stats.scan(df, {"numeric"}, infos)
        fills |= {n: f["mean"] for n, f in found.items() if f["mean"] is not None}
    elif strategy == "most_frequent":
        fills |= {n: float(v) for n, v in modes(df, columns).items()}
    elif strategy != "constant":
        raise AuditError(f"Unknown fill strategy: {strategy}")
    exprs = {c.name: F.coalesce(cells.finite(c.name, c.dtype), F.lit(float(fills[c.name]))) for c in infos}
    found = stats.reduce_cells(df, exprs, {"mean": "avg(x)", "scale": "stddev_pop(x)"})
    rows = [
        {"column": n, "fill": float(fills[n]), "mean": found[n]["mean"], "scale": found[n]["scale"] or 1.0}
        for n in columns if n in found
    ]
    return small_table(df.sparkSession, rows, {"column": "string", "fill": "double", "mean": "double", "scale": "double"})


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent non-null cell per column, the smallest value on ties (numbers compared as numbers)."""
    infos = columns_of(df, columns)
    order = F.struct(-F.col("cnt"), F.expr("try_cast(value AS DOUBLE)"), F.col("value"))
    rows = stats.value_frequency(df, infos).where("value IS NOT NULL").groupBy("column").agg(F.min_by("value", order).alias("v")).collect()
    return {r["column"]: r["v"] for r in rows}


def impute_scale(df: DataFrame, columns: list[str], strategy: str = "median") -> DataFrame:
    """Numeric columns filled and scaled to mean 0 and deviation 1 (learned on df)."""
    learned = {r["column"]: r for r in learn_numeric(df, columns, strategy).collect()}
    out = []
    for f in df.schema.fields:
        if f.name in learned:
            r = learned[f.name]
            x = F.coalesce(cells.finite(f.name, f.dataType), F.lit(r["fill"]))
            out.append(((x - r["mean"]) / r["scale"]).alias(f.name))
        else:
            out.append(cells.qcol(f.name))
    return df.select(*out)


def categories(df: DataFrame, columns: list[str], max_categories: int = 0) -> DataFrame:
    """(column, value, cnt, position): categories in label order; beyond the limit the rest become one infrequent slot."""
    freq = stats.value_frequency(df, columns_of(df, columns)).where("value IS NOT NULL")
    if max_categories > 1:
        # Rank inside hash slices first, so that no task orders a whole high-cardinality column.
        order = [F.desc("cnt"), F.col("value")]
        sliced = freq.withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(256)))
        near = sliced.withColumn("r", F.row_number().over(Window.partitionBy("column", "slice").orderBy(*order)))
        top = near.where(F.col("r") < max_categories).withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
        kept = top.where(F.col("r") < max_categories).select("column", "value", "cnt")
        all_of = freq.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("total"))
        kept_of = kept.groupBy("column").agg(F.count(F.lit(1)).alias("k"), F.sum("cnt").alias("kept"))
        rest = all_of.join(kept_of, "column").where("n > k").select("column", F.lit(INFREQUENT).alias("value"), F.expr("total - kept").alias("cnt"))
        # With one value left over it keeps its own slot, as the limit is not exceeded.
        exact = all_of.where(F.col("n") <= max_categories).select("column")
        freq = freq.join(exact, "column", "left_semi").unionByName(
            kept.join(exact, "column", "left_anti")).unionByName(rest.join(exact, "column", "left_anti"))
    return freq


class CalendarStage(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage that adds the calendar parts of its input columns."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return calendar_features(dataset, self.getInputCols())


class FeatureEncoder(Estimator):
    """Learns fills, scales and categories on the training rows and yields a PipelineModel with a `features` vector.

    Numbers: fill and standardise. Text and booleans: fill with the mode (or a
    constant) and one-hot encode; unknown labels become all zeros. Datetimes:
    calendar parts, median fill, scaling without centring.
    """

    def __init__(
        self, groups: FeatureGroups, numeric_strategy: str = "median", categorical_strategy: str = "most_frequent",
        numeric_constant: float = 0.0, categorical_constant: str = "missing", scale: bool = True, max_categories: int = 0,
    ):
        super().__init__()
        self.groups, self.scale, self.max_categories = groups, scale, max_categories
        self.numeric_strategy, self.numeric_constant = numeric_strategy, numeric_constant
        self.categorical_strategy, self.categorical_constant = categorical_strategy, categorical_constant
        if not (groups.numeric or groups.categorical or groups.datetime):
            raise AuditError("No supported feature column is left.")

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        quote = lambda n: "`" + n.replace("`", "``") + "`"
        safe = lambda n: n.replace(".", "_").replace("`", "_")
        g, select, inputs, stages = self.groups, [], [], []

        def scaled(raw: str, learned, out: str, centre: bool):
            shift = f" - ({learned['mean']!r}D)" if centre else ""
            body = f"coalesce({raw}, {learned['fill']!r}D)"
            return f"({body}{shift}) / {learned['scale']!r}D AS {quote(out)}" if self.scale or not centre else f"{body} AS {quote(out)}"

        for r in learn_numeric(dataset, g.numeric, self.numeric_strategy, self.numeric_constant).collect():
            raw = quote(r["column"])
            finite = f"CASE WHEN abs(CAST({raw} AS DOUBLE)) < double('infinity') THEN CAST({raw} AS DOUBLE) END"
            select.append(scaled(finite, r, f"numeric__{safe(r['column'])}", True))
            inputs.append(f"numeric__{safe(r['column'])}")
        prepared = dataset
        if g.datetime:
            # Date text is parsed before the SQL stage so that training and scoring share one parser.
            prepared = calendar_features(dataset, g.datetime)
            parts = [c for c in prepared.columns if c not in dataset.columns]
            stages.append(CalendarStage(inputCols=g.datetime))
            for r in learn_numeric(prepared, parts, "median").collect():
                select.append(scaled(quote(r["column"]), r, f"datetime__{safe(r['column'])}", False))
                inputs.append(f"datetime__{safe(r['column'])}")
        labels: dict[str, list[str]] = {}
        if g.categorical:
            fills = modes(dataset, g.categorical) if self.categorical_strategy == "most_frequent" else {}
            table = categories(self._filled(dataset, fills), g.categorical, self.max_categories)
            size = table.count()
            if size > MAX_ENCODED:
                raise AuditError(f"{size} categories are too many to one-hot encode; set max_categories or drop columns.")
            for r in table.orderBy("column", "value").collect():
                labels.setdefault(r["column"], []).append(r["value"])
            for n in g.categorical:
                known = labels.get(n, [])
                fill = fills.get(n, self.categorical_constant).replace("\\", "\\\\").replace("'", "\\'")
                cell = f"CAST({quote(n)} AS STRING)"
                value = f"coalesce({cell}, '{fill}')"
                if INFREQUENT in known and self.max_categories > 1:
                    kept = ", ".join("'" + k.replace("\\", "\\\\").replace("'", "\\'") + "'" for k in known if k != INFREQUENT)
                    value = f"CASE WHEN {value} IN ({kept}) THEN {value} ELSE '{INFREQUENT}' END"
                select.append(f"{value} AS {quote('text__' + safe(n))}")
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(select)} FROM __THIS__"))
        encoded = [n for n in g.categorical if labels.get(n)]
        if encoded:
            # One model per column: the multi-column constructor pads shorter label lists with nulls.
            stages += [
                StringIndexerModel.from_labels(labels[n], f"text__{safe(n)}", outputCol=f"index__{safe(n)}", handleInvalid="keep")
                for n in encoded
            ]
            stages.append(OneHotEncoder(
                inputCols=[f"index__{safe(n)}" for n in encoded], outputCols=[f"categorical__{safe(n)}" for n in encoded], dropLast=True))
            inputs += [f"categorical__{safe(n)}" for n in encoded]
        stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error"))
        return Pipeline(stages=stages).fit(dataset)

    def _filled(self, df: DataFrame, fills: dict[str, str]) -> DataFrame:
        return df.select(*[
            F.coalesce(cells.qcol(n).cast("string"), F.lit(fills.get(n, self.categorical_constant))).alias(n)
            for n in self.groups.categorical
        ])


@dataclass
class SparseEncoding:
    """What `fit_sparse` learned: scales of numbers and calendar parts, and categories as a table of any size."""

    groups: FeatureGroups
    numbers: DataFrame  # (column, fill, mean, scale, prefix), one row per number or calendar part
    labels: DataFrame | None  # (column, value)
    fills: dict[str, str]


def fit_sparse(train: DataFrame, groups: FeatureGroups, numeric_strategy: str = "median", max_categories: int = 0) -> SparseEncoding:
    """Learns the encoding of `FeatureEncoder` as tables. Categories stay distributed, so a column may have any number of them."""
    numbers = learn_numeric(train, groups.numeric, numeric_strategy).withColumn("prefix", F.lit("numeric__"))
    if groups.datetime:
        dated = calendar_features(train, groups.datetime)
        parts = learn_numeric(dated, [c for c in dated.columns if c not in train.columns], "median")
        # calendar parts are scaled but not centred
        numbers = numbers.unionByName(parts.withColumns({"mean": F.lit(0.0), "prefix": F.lit("datetime__")}))
    fills = modes(train, groups.categorical) if groups.categorical else {}
    labels = categories(_text_cells(train, groups.categorical, fills), groups.categorical, max_categories).select("column", "value") if groups.categorical else None
    return SparseEncoding(groups, numbers, labels, fills)


def _text_cells(df: DataFrame, columns: list[str], fills: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    filled = [F.coalesce(cells.qcol(n).cast("string"), F.lit(fills.get(n, "missing"))).alias(n) for n in columns]
    return df.select(*[cells.qcol(k) for k in keep], *filled)


def sparse_cells(df: DataFrame, key: str, encoding: SparseEncoding) -> DataFrame:
    """(row_id, slot, value): the cells of the encoded rows that are not zero.

    An unknown category has no cell, or that of the infrequent ones if there is such a slot; a constant number is 0 everywhere.
    """
    g, out = encoding.groups, None
    dated = calendar_features(df, g.datetime) if g.datetime else df
    numbers = [*g.numeric, *[c for c in dated.columns if c not in df.columns]]
    row = cells.qcol(key).alias("row_id")
    if numbers:
        kinds = {f.name: f.dataType for f in dated.schema.fields}
        long = dated.select(row, *[cells.finite(n, kinds[n]).alias(f"c{i}") for i, n in enumerate(numbers)]).unpivot(["row_id"], [f"c{i}" for i in range(len(numbers))], "pos", "x")
        named = long.withColumn("column", F.element_at(F.array(*[F.lit(n) for n in numbers]), F.substring("pos", 2, 9).cast("int") + 1))
        scaled = named.join(F.broadcast(encoding.numbers), "column")  # one row per number or calendar part
        out = scaled.select("row_id", F.concat("prefix", "column").alias("slot"), ((F.coalesce("x", "fill") - F.col("mean")) / F.col("scale")).alias("value"))
    if g.categorical:
        texts = _text_cells(df.withColumn("__row", row), g.categorical, encoding.fills, ("__row",)).unpivot(["__row"], list(g.categorical), "column", "value")
        known = encoding.labels.withColumn("seen", F.lit(True))
        rest = encoding.labels.where(F.col("value") == INFREQUENT).select("column", F.lit(True).alias("pooled"))  # one row per column at most
        found = texts.join(known, ["column", "value"], "left").join(F.broadcast(rest), "column", "left").where("seen OR pooled")
        label = F.when(F.col("seen"), F.col("value")).otherwise(INFREQUENT)
        part = found.select(F.col("__row").alias("row_id"), F.concat(F.lit("categorical__"), "column", F.lit("_"), label).alias("slot"), F.lit(1.0).alias("value"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise AuditError("No supported feature column is left.")
    return out.where("value <> 0")


def feature_names(encoded: DataFrame, column: str = "features") -> list[str]:
    """Names of the vector slots, from the column metadata."""
    attrs = encoded.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    flat = sorted((a["idx"], a["name"]) for kind in attrs.values() for a in kind)
    return [n for _, n in flat]
