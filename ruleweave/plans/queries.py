"""Queries over the driver's tables, one or more per operator, and their DuckDB SQL.

Rules are fixed tables here, so that every result but the trained ones has an
SQL counterpart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ruleweave.functions import bits as B
from ruleweave.functions import text as T
from ruleweave.operators import evaluate, inspect, logs, metrics
from ruleweave.operators.encode import Encoder, quantile_thresholds
from ruleweave.plans import models

#: (output, clause, feature, negated): rules over the nine thermometer bits of orders.
RULES = [(0, 0, 0, True), (0, 0, 3, False), (0, 1, 1, False), (0, 2, 4, True), (0, 2, 6, False), (0, 3, 8, False), (1, 0, 2, False), (1, 1, 0, True), (1, 1, 5, True), (1, 2, 7, False), (1, 2, 4, False), (1, 3, 3, True)]
#: (output, clause, weight).
WEIGHTS = [(0, 0, 3), (0, 1, 2), (0, 2, 1), (0, 3, 4), (1, 0, 2), (1, 1, 3), (1, 2, 5), (1, 3, 1)]
#: Signed weights of the shared bank that has the rules of output 0 as clauses 0 to 3.
SHARED_WEIGHTS = [(0, 0, 2), (0, 1, -3), (0, 2, 1), (0, 3, -1), (1, 0, -2), (1, 1, 4), (1, 2, 2), (1, 3, 1)]
#: (output, clause, feature, negated) over patches of three signs, and of two by two.
PATCH_RULES = [(0, 0, 0, False), (0, 0, 1, True), (0, 1, 2, False), (0, 1, 0, True), (1, 0, 1, False), (1, 0, 2, True), (1, 1, 0, False), (1, 1, 1, False), (1, 1, 2, False)]
THRESHOLD = 4
#: (output, clause, replica, value): cells of three replicas.
CELLS = [(0, 0, 0, 7), (0, 0, 1, 8), (0, 0, 2, 8), (0, 1, 0, 1), (0, 1, 1, 1), (0, 1, 2, 2), (1, 0, 0, -4), (1, 0, 1, -5), (1, 0, 2, -5), (1, 1, 0, -1), (1, 1, 1, 0), (1, 1, 2, 0)]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lits(spark: SparkSession, rules=RULES, shared: bool = False) -> DataFrame:
    rows = [(evaluate.SHARED, c, f, n) for o, c, f, n in rules if o == 0] if shared else rules
    return spark.createDataFrame(rows, "output int, clause int, feature int, negated boolean")


def _weights(spark: SparkSession, rows=WEIGHTS) -> DataFrame:
    return spark.createDataFrame(rows, "output int, clause int, weight int")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice", F.col("o_custkey").cast("double").alias("custkey"), (F.col("o_orderkey") % 97).cast("double").alias("slot"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))


COLUMNS = ["o_totalprice", "custkey", "slot"]


def _samples(spark: SparkSession, d: str) -> DataFrame:
    orders = _orders(spark, d)
    return Encoder.fit_numeric(orders, COLUMNS, 3).encode(orders).select("row_id", "bits", "label")


def _signs(spark: SparkSession, d: str, n: int = 64) -> DataFrame:
    """Signs of the first n of the 64 components: the fixed rules, and their SQL, are defined on those features only."""
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform(F.slice("embedding", 1, n), lambda v: (v > 0).cast("tinyint")).alias("bits"), "label")


def _event_tokens(spark: SparkSession, d: str) -> DataFrame:
    user = F.concat(F.lit("user::u"), (F.col("user_id") % 7).cast("string"))
    return _t(spark, d, "events").select("event_id", "ts", F.array(T.token("type", F.col("event_type")), user).alias("tokens"))


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events without some type and user, and those with them."""
    events = _event_tokens(spark, d)
    early = ~F.array_contains("tokens", "user::u3") & ~F.array_contains("tokens", "type::purchase")
    return events.where(early), events.where(~early)


def quantile_fit(spark, d):
    return quantile_thresholds(_orders(spark, d), COLUMNS, 3).select("feature", "t", F.round("threshold", 6).alias("threshold"))


def thermometer_encode(spark, d):
    return _samples(spark, d).select(F.posexplode("bits").alias("bit", "value")).groupBy("bit").agg(F.sum("value").alias("ones"))


def literal_packing(spark, d):
    return _samples(spark, d).select("row_id", F.get(B.pack(F.col("bits"), 9), F.lit(0)).alias("word"), F.size(B.literals(F.col("bits"))).alias("n_literals"))


def vocabulary_fit(spark, d):
    return Encoder.vocabulary_table(_event_tokens(spark, d))


def categorical_encode(spark, d):
    """All events by the vocabulary of the first part, so that unknown tokens occur."""
    early, late = _halves(spark, d)
    return Encoder.fit_categorical(early).encode_relational(early.unionByName(late), "event_id").groupBy("bit").agg(F.count("*").alias("n"))


def vocabulary_extend(spark, d):
    early, late = _halves(spark, d)
    encoder = Encoder.fit_categorical(early)
    encoder.extend_categorical(late)
    return encoder.table(spark).select("token", "bit")


def clause_firing(spark, d):
    return evaluate.fired(_samples(spark, d), _lits(spark)).groupBy("output", "clause").agg(F.count("*").alias("n"))


def clause_blocking(spark, d):
    rules = [(o, c, sorted(f + 9 * n for o2, c2, f, n in RULES if (o2, c2) == (o, c))) for o, c in sorted({r[:2] for r in RULES})]
    rows = _samples(spark, d).select(B.literals(F.col("bits")).alias("lits"), F.explode(F.array(*[F.struct(F.lit(o).alias("output"), F.lit(c).alias("clause"), F.array(*map(F.lit, i)).alias("inc")) for o, c, i in rules])).alias("r"))
    return rows.groupBy(F.col("r.output").alias("output"), F.col("r.clause").alias("clause"), B.first_blocking(F.col("r.inc"), F.col("lits")).alias("blocking")).agg(F.count("*").alias("n"))


def vanilla_scores(spark, d):
    """The flagship: encode, fire, vote, clamp, argmax, compare with the label; one pass."""
    scored = evaluate.scored_rows(_samples(spark, d), _lits(spark), evaluate.parity_weights(_weights(spark)), 2, THRESHOLD)
    return scored.select("prediction", F.get("scores", F.col("prediction")).alias("score"), "label").groupBy("prediction", "score", "label").agg(F.count("*").alias("n"))


def vanilla_accuracy(spark, d):
    found = evaluate.scored_rows(_samples(spark, d), _lits(spark), evaluate.parity_weights(_weights(spark)), 2, THRESHOLD)
    return metrics.accuracy(found).select(F.round("accuracy", 9).alias("accuracy"), "n")


def coalesced_predict(spark, d):
    return evaluate.predict_coalesced(_samples(spark, d), _lits(spark, shared=True), _weights(spark, SHARED_WEIGHTS), 2).groupBy("prediction").agg(F.count("*").alias("n"))


def coalesced_scores(spark, d):
    scored = evaluate.scored_rows(_samples(spark, d), _lits(spark, shared=True), _weights(spark, SHARED_WEIGHTS), 2, 2)
    return scored.select(F.posexplode("scores").alias("output", "score")).groupBy("output", "score").agg(F.count("*").alias("n"))


def joined_scores(spark, d):
    """The flagship's scores by joins of literals, clauses and weights, as models beyond evaluate.HELD are scored."""
    samples, lits = _samples(spark, d), _lits(spark)
    needed = lits.groupBy("output", "clause").agg(F.count("*").alias("needed"))
    met = evaluate.sample_literals(samples).join(lits, ["feature", "negated"]).groupBy("row_id", "output", "clause").agg(F.count("*").alias("met"))
    firing = met.join(needed, ["output", "clause"]).where("met = needed").select("row_id", "output", "clause")
    scored = evaluate.scores(evaluate.votes(samples, firing, evaluate.parity_weights(_weights(spark)), 2), THRESHOLD)
    best = evaluate.argmax(scored).join(scored, "row_id").where("output = prediction").select("row_id", "prediction", "score")
    return best.join(samples.select("row_id", "label"), "row_id").groupBy("prediction", "score", "label").agg(F.count("*").alias("n"))


def _conv(spark, d, patches):
    samples = _signs(spark, d)
    weights = spark.createDataFrame([(0, 0, 2), (0, 1, 1), (1, 0, 2), (1, 1, 1)], "output int, clause int, weight int")
    found = evaluate.scored_rows(samples, _lits(spark, PATCH_RULES), evaluate.parity_weights(weights), 2, THRESHOLD, True, patches)
    return found.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def convolution_1d(spark, d):
    return _conv(spark, d, B.patches_1d(F.col("bits"), 64, 3, 2))


def convolution_2d(spark, d):
    return _conv(spark, d, B.patches_2d(F.col("bits"), (8, 8), (2, 2), 2))


def composite_predict(spark, d):
    swapped = [(1 - o, c, w) for o, c, w in WEIGHTS]
    members = [(_lits(spark), evaluate.parity_weights(_weights(spark, w)), t) for w, t in ((WEIGHTS, 2), (swapped, 3))]
    return evaluate.composite_rows(_samples(spark, d), members, 2).groupBy("prediction").agg(F.count("*").alias("n"))


def _parts(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.array((F.col("p_size") > 10).cast("tinyint"), (F.col("p_size") > 25).cast("tinyint"), (F.col("p_retailprice") > 1200).cast("tinyint")).alias("bits"), F.col("p_size").cast("double").alias("target"))
    lits = spark.createDataFrame([(0, 0, 0, False), (0, 1, 1, False), (0, 2, 2, True), (0, 2, 0, False)], "output int, clause int, feature int, negated boolean")
    return rows, lits, spark.createDataFrame([(0, 0, 12), (0, 1, 20), (0, 2, 3)], "output int, clause int, weight int")


def regression_predict(spark, d):
    rows, lits, weights = _parts(spark, d)
    return evaluate.predict_regression(rows, lits, weights, 30).groupBy("prediction").agg(F.count("*").alias("n"))


def regression_errors(spark, d):
    rows, lits, weights = _parts(spark, d)
    found = evaluate.predict_regression(rows, lits, weights, 30).join(rows.select("row_id", "target"), "row_id")
    return metrics.regression_errors(found).select(F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


def _reconstructed(spark, d):
    samples = _signs(spark, d, 4)
    lits = spark.createDataFrame([(-1, 0, 0, False), (-1, 1, 1, False), (-1, 1, 2, True), (-1, 2, 3, True)], "output int, clause int, feature int, negated boolean")
    weights = spark.createDataFrame([(0, 0, 2), (0, 1, -1), (0, 2, -1), (1, 0, 1), (1, 1, 3), (1, 2, -1), (2, 0, 1), (2, 1, -2), (2, 2, 1), (3, 0, 1), (3, 1, 1), (3, 2, -2)], "output int, clause int, weight int")
    return evaluate.reconstruct(samples, lits, weights, 4), samples


def reconstruction_errors(spark, d):
    found, samples = _reconstructed(spark, d)
    return metrics.feature_errors(found, samples).select("output", F.round("error", 9).alias("error"))


def reconstruction_by_group(spark, d):
    found, samples = _reconstructed(spark, d)
    errors = metrics.row_errors(found, samples).join(samples.select("row_id", "label"), "row_id")
    groups = spark.range(12).select(F.col("id").cast("int").alias("label"))
    return metrics.group_errors(errors, groups, "label").select("label", "n", F.round("error", 9).alias("error"))


def confusion_matrix(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("prediction")).join(_t(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    found = metrics.confusion(docs)
    return found.select("tp", "fp", "tn", "fn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def class_weights(spark, d):
    return metrics.class_weights(_t(spark, d, "labels").withColumnRenamed("quality", "label")).select("label", "n", F.round("weight", 9).alias("weight"))


def _words(column="text"):
    return F.filter(F.split(F.lower(column), "[^a-z]+"), lambda w: w != "")


def top_tokens(spark, d):
    return logs.top_tokens(_t(spark, d, "documents"), _words(), 50)


def keep_top_tokens(spark, d):
    docs = _t(spark, d, "documents")
    kept = logs.keep_tokens(docs, "doc_id", _words(), logs.top_tokens(docs, _words(), 50))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("token").alias("n_distinct"))


def window_token_counts(spark, d):
    return logs.window_counts(_t(spark, d, "events"), "ts", "10 minutes", F.col("event_type")).select(F.unix_timestamp("window_start").alias("window_start"), "token", "n")


def window_features(spark, d):
    types = ["click", "purchase", "view"]
    found = logs.window_features(_t(spark, d, "events"), "ts", "1 day", types, F.col("event_type"), F.col("user_id"))
    return found.select(F.unix_timestamp("window_start").alias("window_start"), "n_events", "n_distinct", F.array_join(F.transform("bits", lambda b: b.cast("string")), "").alias("bits"))


def json_tokens(spark, d):
    return logs.json_tokens(_t(spark, d, "events"), "event_id", "props").groupBy("token").agg(F.count("*").alias("n"))


def text_functions(spark, d):
    url = F.translate("url", "/", "\\")
    pages = _t(spark, d, "pages")
    return pages.select("page_id", T.basename(url).alias("base"), T.hive(url).alias("hive"), F.array_join(T.command_tokens(F.translate("url", "/:.", "   ")), " ").alias("tokens"), T.column_prefix(F.concat(F.lit("host::"), F.col("url"))).alias("prefix"))


def rule_rendering(spark, d):
    return inspect.rules(_lits(spark))


def literal_frequency(spark, d):
    return inspect.literal_frequency(_lits(spark))


def replica_merge(spark, d):
    cells = spark.createDataFrame(CELLS, "output int, clause int, replica int, value int")
    plain = inspect.merge_replicas(cells.where("value >= 0 and output = 0"), ["output", "clause"], replicas=3)
    return plain.unionByName(inspect.merge_replicas(cells.where("output = 1"), ["output", "clause"], replicas=3, signed=True))


def feature_growth(spark, d):
    cells = spark.createDataFrame([(0, c, f, n, 10 * c + f) for c in (0, 1) for f in (0, 1) for n in (False, True)], "output int, clause int, feature int, negated boolean, state int")
    return inspect.grow(cells, 2, 4, 8)


def absorbed_fractions(spark, d):
    cells = _t(spark, d, "lineitem").select(F.least(F.col("l_quantity"), F.lit(40.0)).cast("int").alias("state"))
    found = inspect.absorbed(cells, 40)
    return found.select(F.round("included", 9).alias("included"), F.round("excluded", 9).alias("excluded"))


def clause_polarity(spark, d):
    mixed = inspect.mixed_polarity(_weights(spark, SHARED_WEIGHTS))
    sizes = inspect.clause_sizes(_lits(spark).where("output = 0"), _weights(spark).where("output = 0")).select("clause", "n")
    return mixed.join(sizes, "clause")


def argmax_ties(spark, d):
    """First and last winner of equal scores, by row_number as the definition has it."""
    rows = spark.createDataFrame([(r, o, (r * (o + 1)) % 3) for r in range(12) for o in range(4)], "row_id bigint, output int, score int")
    w = Window.partitionBy("row_id").orderBy(F.desc("score"), "output")
    by_rank = rows.withColumn("k", F.row_number().over(w)).where("k = 1").select("row_id", F.col("output").alias("ranked"))
    return evaluate.argmax(rows).join(evaluate.argmax(rows, last_wins=True).withColumnRenamed("prediction", "last"), "row_id").join(by_rank, "row_id")


def train_and_predict(spark, d):
    """Train a model on all orders' bits and predict them; SQL can't express it. Exact: a class's packed samples are in one task."""
    samples = _samples(spark, d)
    model = models.VanillaClassifier(2, 9, 10, 10, 3.0, seed=7)
    model.fit(samples, epochs=2)
    return model.transform(samples).select("row_id", "label", "prediction")


_ENTRIES = [quantile_fit, thermometer_encode, literal_packing, vocabulary_fit, categorical_encode, vocabulary_extend, clause_firing, clause_blocking, vanilla_scores, vanilla_accuracy, coalesced_predict, coalesced_scores, joined_scores, convolution_1d, convolution_2d, composite_predict, regression_predict, regression_errors, reconstruction_errors, reconstruction_by_group, confusion_matrix, class_weights, top_tokens, keep_top_tokens, window_token_counts, window_features, json_tokens, text_functions, rule_rendering, literal_frequency, replica_merge, feature_growth, absorbed_fractions, clause_polarity, argmax_ties, train_and_predict]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ENTRIES}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(v).lower() if isinstance(v, bool) else str(v) for v in r) + ")" for r in rows)


_TH = """v as (select 0 as f, o_totalprice as v from orders union all select 1, cast(o_custkey as double) from orders union all select 2, cast(o_orderkey % 97 as double) from orders),
 ranked as (select f, v, row_number() over (partition by f order by v) - 1 as rn, count(*) over (partition by f) as n from v),
 th as (select f, t, v as threshold from ranked, (values (0), (1), (2)) as x(t) where rn = ((n - 1) * (t + 1)) // 4)"""
_BITS = _TH + """, bits as (select o_orderkey as row_id, f * 3 + t as bit, cast(case f when 0 then o_totalprice when 1 then o_custkey else o_orderkey % 97 end > threshold as integer) as b, cast(o_orderstatus = 'F' as integer) as label from orders, th),
 rows_ as (select distinct row_id, label from bits)"""


def _fired(rules, source: str = "bits", keys: str = "row_id") -> str:
    return f"""rules as (select * from (values {_values(rules)}) as x(output, clause, feature, negated)),
 needed as (select output, clause, count(*) as needed from rules group by output, clause),
 met as (select {keys}, r.output, r.clause, count(*) as met from {source} s join rules r on s.bit = r.feature and (s.b = 0) = r.negated group by {keys}, r.output, r.clause),
 fired as (select {keys}, met.output, met.clause from met join needed on met.output = needed.output and met.clause = needed.clause where met = needed)"""


def _voted(weights, outputs: int = 2, parity: bool = True, name: str = "voted", rows: str = "rows_", firing: str = "fired", shared: bool = False) -> str:
    on = "f.clause = w.clause" + ("" if shared else " and f.output = w.output")
    sign = "case when w.clause % 2 = 0 then w.weight else -w.weight end" if parity else "w.weight"
    return f"""{name} as (select r.row_id, o.output, coalesce(s.v, 0) as votes from {rows} r cross join (select unnest(range({outputs})) as output) o
 left join (select f.row_id, w.output, sum({sign}) as v from {firing} f join (values {_values(weights)}) as w(output, clause, weight) on {on} group by f.row_id, w.output) s on s.row_id = r.row_id and s.output = o.output)"""


def _best(source: str, value: str, last: bool = False, name: str = "best") -> str:
    return f"{name} as (select row_id, output as prediction, {value} as score from (select *, row_number() over (partition by row_id order by {value} desc, output {'desc' if last else 'asc'}) as k from {source}) where k = 1)"


_CLAMPED = "scored as (select row_id, output, greatest(-{t}, least({t}, votes)) as score from voted)"
_SHARED_RULES = [(0, c, f, n) for o, c, f, n in RULES if o == 0]
_SIGNS = "signs as (select vec_id as row_id, label, i - 1 as i, cast(embedding[i] > 0 as integer) as b from embeddings, (select unnest(range(1, {n} + 1)) as i))"
_EVENT = "tok as (select event_id, unnest(['type::' || event_type, 'user::u' || cast(user_id % 7 as varchar)]) as token, user_id % 7 <> 3 and event_type <> 'purchase' as early from events)"
_VOCABULARY = """seen as (select distinct token from {source}), unk as (select distinct split_part(token, '::', 1) || '::<UNK>' as token from seen),
 vocab as (select token, row_number() over (order by k, token) - 1 as bit, k from (select token, 0 as k from seen union all select token, 1 from unk where token not in (select token from seen) union all select '<OOV>', 2))"""
_CONV = "weights as (select * from (values (0, 0, 2), (0, 1, 1), (1, 0, 2), (1, 1, 1)) as x(output, clause, weight))"
_CONV_W = [(0, 0, 2), (0, 1, 1), (1, 0, 2), (1, 1, 1)]
_AE_RULES = [(0, 0, 0, False), (0, 1, 1, False), (0, 1, 2, True), (0, 2, 3, True)]
_AE_W = [(0, 0, 2), (0, 1, -1), (0, 2, -1), (1, 0, 1), (1, 1, 3), (1, 2, -1), (2, 0, 1), (2, 1, -2), (2, 2, 1), (3, 0, 1), (3, 1, 1), (3, 2, -2)]
_AE = f"""{_SIGNS.format(n=4)}, bits as (select row_id, i as bit, b from signs), rows_ as (select distinct row_id from bits), {_fired(_AE_RULES)}, {_voted(_AE_W, 4, parity=False, shared=True)},
 rec as (select v.row_id, v.output, cast(v.votes > 0 as integer) <> s.b as wrong, s.label from voted v join signs s on v.row_id = s.row_id and v.output = s.i)"""
_PART_RULES, _PART_W = [(0, 0, 0, False), (0, 1, 1, False), (0, 2, 2, True), (0, 2, 0, False)], [(0, 0, 12), (0, 1, 20), (0, 2, 3)]
_PART = f"""pb as (select p_partkey as row_id, cast(p_size as double) as target, [cast(p_size > 10 as integer), cast(p_size > 25 as integer), cast(p_retailprice > 1200 as integer)] as a from part),
 bits as (select row_id, i - 1 as bit, a[i] as b from pb, (select unnest(range(1, 4)) as i)), rows_ as (select row_id from pb), {_fired(_PART_RULES)}, {_voted(_PART_W, 1, parity=False)},
 pred as (select row_id, cast(greatest(0, least(30, votes)) as double) as prediction from voted)"""
_WORD = "w as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) as token from documents), top as (select token, count(*) as n from w group by token order by n desc, token limit 50)"


def _patched(bit: str, where: str) -> str:
    return f"""with {_SIGNS.format(n=64)}, bits as (select row_id, p, k as bit, b from signs, (select unnest(range(31)) as p), (select unnest(range(4)) as k) where i = {bit} and {where}),
 rows_ as (select distinct row_id from signs), {_fired(PATCH_RULES, keys="row_id, p")}, any_ as (select distinct row_id, output, clause from fired), {_voted(_CONV_W, firing="any_")}, {_CLAMPED.format(t=THRESHOLD)}, {_best("scored", "score", last=True)}
 select label, prediction, count(*) as n from best join (select distinct row_id, label from signs) using (row_id) group by label, prediction"""


ORACLE: dict[str, str] = {
    "quantile_fit": f"with {_TH} select f as feature, t, round(threshold, 6) as threshold from th",
    "thermometer_encode": f"with {_BITS} select cast(bit as integer) as bit, cast(sum(b) as bigint) as ones from bits group by bit",
    "literal_packing": f"with {_BITS} select row_id, cast(sum(case when b = 1 then 1 << bit else 1 << (bit + 9) end) as bigint) as word, cast(count(*) as integer) as n_literals from bits group by row_id",
    "vocabulary_fit": f"with {_EVENT}, {_VOCABULARY.format(source='tok')} select token, cast(bit as integer) as bit, case k when 0 then 'token' when 1 then 'unknown' else 'oov' end as kind from vocab",
    "categorical_encode": f"with {_EVENT}, early as (select token from tok where early), {_VOCABULARY.format(source='early')}, e as (select distinct event_id, coalesce(v.bit, u.bit, (select bit from vocab where k = 2)) as bit from tok left join vocab v on tok.token = v.token left join vocab u on split_part(tok.token, '::', 1) || '::<UNK>' = u.token) select cast(bit as integer) as bit, count(*) as n from e group by bit",
    "vocabulary_extend": f"with {_EVENT}, early as (select token from tok where early), {_VOCABULARY.format(source='early')}, fresh as (select token, row_number() over (order by token) - 1 + (select count(*) from vocab) as bit from (select distinct token from tok where token not in (select token from vocab))) select token, cast(bit as integer) as bit from vocab union all select token, cast(bit as integer) from fresh",
    "clause_firing": f"with {_BITS}, {_fired(RULES)} select output, clause, count(*) as n from fired group by output, clause",
    "clause_blocking": f"with {_BITS}, rules as (select * from (values {_values(RULES)}) as x(output, clause, feature, negated)), j as (select row_id, output, clause, min(case when (b = 0) <> negated then feature + case when negated then 9 else 0 end end) as blocking from bits join rules on bit = feature group by row_id, output, clause) select output, clause, blocking, count(*) as n from j group by output, clause, blocking",
    "vanilla_scores": f"with {_BITS}, {_fired(RULES)}, {_voted(WEIGHTS)}, {_CLAMPED.format(t=THRESHOLD)}, {_best('scored', 'score')} select prediction, cast(score as bigint) as score, label, count(*) as n from best join rows_ using (row_id) group by all",
    "joined_scores": f"with {_BITS}, {_fired(RULES)}, {_voted(WEIGHTS)}, {_CLAMPED.format(t=THRESHOLD)}, {_best('scored', 'score')} select prediction, cast(score as bigint) as score, label, count(*) as n from best join rows_ using (row_id) group by all",
    "vanilla_accuracy": f"with {_BITS}, {_fired(RULES)}, {_voted(WEIGHTS)}, {_CLAMPED.format(t=THRESHOLD)}, {_best('scored', 'score')} select round(avg(cast(prediction = label as integer)), 9) as accuracy, count(*) as n from best join rows_ using (row_id)",
    "coalesced_predict": f"with {_BITS}, {_fired(_SHARED_RULES)}, {_voted(SHARED_WEIGHTS, parity=False, shared=True)}, {_best('voted', 'votes')} select prediction, count(*) as n from best group by prediction",
    "coalesced_scores": f"with {_BITS}, {_fired(_SHARED_RULES)}, {_voted(SHARED_WEIGHTS, parity=False, shared=True)}, {_CLAMPED.format(t=2)} select cast(output as integer) as output, cast(score as bigint) as score, count(*) as n from scored group by output, score",
    "convolution_1d": _patched("p * 2 + k", "k < 3 and p < 31"),
    "convolution_2d": _patched("(p // 4 * 2 + k // 2) * 8 + p % 4 * 2 + k % 2", "p < 16"),
    "composite_predict": f"with {_BITS}, {_fired(RULES)}, {_voted(WEIGHTS, name='a')}, {_voted([(1 - o, c, w) for o, c, w in WEIGHTS], name='b')}, scored as (select row_id, a.output, greatest(-2, least(2, a.votes)) + greatest(-3, least(3, b.votes)) as score from a join b using (row_id, output)), {_best('scored', 'score', last=True)} select prediction, count(*) as n from best group by prediction",
    "regression_predict": f"with {_PART} select prediction, count(*) as n from pred group by prediction",
    "regression_errors": f"with {_PART} select round(avg(abs(prediction - target)), 6) as mae, round(sqrt(avg((prediction - target) ** 2)), 6) as rmse from pred join pb using (row_id)",
    "reconstruction_errors": f"with {_AE} select cast(output as integer) as output, round(avg(cast(wrong as integer)), 9) as error from rec group by output",
    "reconstruction_by_group": f"with {_AE}, e as (select row_id, label, avg(cast(wrong as integer)) as error from rec group by row_id, label), g as (select label, count(*) as n, avg(error) as error from e group by label) select cast(x.label as integer) as label, coalesce(n, 0) as n, round(coalesce(error, 0.0), 9) as error from (select unnest(range(12)) as label) x left join g on x.label = g.label",
    "confusion_matrix": "with j as (select n_chars > 1500 as p, quality = 1 as y from documents join labels using (doc_id)), c as (select count(*) filter (p and y) as tp, count(*) filter (p and not y) as fp, count(*) filter (not p and not y) as tn, count(*) filter (not p and y) as fn from j) select tp, fp, tn, fn, round(case when tp + fp > 0 then tp / (tp + fp) else 0.0 end, 9) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0.0 end, 9) as recall from c",
    "class_weights": "with c as (select quality as label, count(*) as n from labels group by quality) select label, n, round((select sum(n) from c) / ((select count(*) from c) * n), 9) as weight from c",
    "top_tokens": f"with {_WORD} select token, n from top",
    "keep_top_tokens": f"with {_WORD} select doc_id, count(*) as n, count(distinct token) as n_distinct from w where token in (select token from top) group by doc_id",
    "window_token_counts": "select cast(floor(epoch(ts) / 600) * 600 as bigint) as window_start, event_type as token, count(*) as n from events group by 1, 2",
    "window_features": "with g as (select cast(floor(epoch(ts) / 86400) * 86400 as bigint) as window_start, count(*) as n_events, count(distinct user_id) as n_distinct, " + ", ".join(f"count(*) filter (event_type = '{t}') as c{i}" for i, t in enumerate(["click", "purchase", "view"])) + " from events group by 1) select window_start, n_events, n_distinct, concat(" + ", ".join([f"cast(c{i} >= {t} as integer)" for i in range(3) for t in (1, 3, 10)] + [f"cast(n_events >= {t} as integer)" for t in (5, 20, 50, 100)] + [f"cast(n_distinct >= {t} as integer)" for t in (2, 5, 10)]) + ") as bits from g",
    "json_tokens": "with k as (select props, unnest(json_keys(props)) as k from events), x as (select k || '::' || json_extract_string(props, '$.' || k) as token, json_type(props, '$.' || k) as t, json_extract_string(props, '$.' || k) as v from k) select token, count(*) as n from x where t not in ('NULL', 'ARRAY', 'OBJECT') and v <> '' group by token",
    "text_functions": r"with u as (select page_id, url, replace(url, '/', '\') as p from pages) select page_id, regexp_extract(p, '[^\\/]*$') as base, split_part(p, '\', 1) as hive, array_to_string(list_filter(regexp_split_to_array(lower(translate(url, '/:.', '   ')), '[\s,;|&()""''`]+'), lambda t: strlen(t) >= 3 and not regexp_full_match(t, '[0-9a-f]+')), ' ') as tokens, 'host' as prefix from u".replace('""', '"'),
    "rule_rendering": f"select output, clause, cast(count(*) as integer) as n_literals, string_agg(case when negated then '¬' else '' end || 'x' || cast(feature as varchar), ' ∧ ' order by feature, negated) as rule from (values {_values(RULES)}) as x(output, clause, feature, negated) group by output, clause",
    "literal_frequency": f"select feature, count(*) as n from (values {_values(RULES)}) as x(output, clause, feature, negated) group by feature",
    "replica_merge": f"select output, clause, cast(case when sum(value) >= 0 then (sum(value) + 1) // 3 else -((-sum(value) + 1) // 3) end as bigint) as value from (values {_values(CELLS)}) as x(output, clause, replica, value) group by output, clause",
    "feature_growth": "with c as (select c, f, n from (values (0), (1)) as a(c), (values (0), (1), (2), (3)) as b(f), (values (true), (false)) as d(n)) select 0 as output, c as clause, f as feature, n as negated, cast(case when f < 2 then 10 * c + f else 7 end as integer) as state from c",
    "absorbed_fractions": "with s as (select cast(least(l_quantity, 40.0) as integer) as state from lineitem) select round(avg(cast(state = 40 as integer)), 9) as included, round(avg(cast(state = 0 as integer)), 9) as excluded from s",
    "clause_polarity": f"with w as (select * from (values {_values(SHARED_WEIGHTS)}) as x(output, clause, weight)), r as (select clause, count(*) as n from (values {_values(RULES)}) as y(output, clause, feature, negated) where output = 0 group by clause) select w.clause, bool_or(weight > 0) and bool_or(weight < 0) as mixed, any_value(n) as n from w join r on w.clause = r.clause group by w.clause",
    "argmax_ties": "with r as (select a as row_id, o as output, (a * (o + 1)) % 3 as score from (select unnest(range(12)) as a), (select unnest(range(4)) as o)), x as (select row_id, output, row_number() over (partition by row_id order by score desc, output) as k, row_number() over (partition by row_id order by score desc, output desc) as l from r) select row_id, cast(max(output) filter (k = 1) as integer) as prediction, cast(max(output) filter (l = 1) as integer) as last, cast(max(output) filter (k = 1) as integer) as ranked from x group by row_id",
}
