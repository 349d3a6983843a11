"""Queries over the test tables, each an operator or a chain of them, and SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.columns import c
from ..core.condition import Contains, HasKeys, HasPrefix, In, Not, Reduce
from ..functions import arrays
from ..functions.passages import gen_passages
from ..operators import basics, collate, datasets, nesting, pipelines, predict
from ..operators.passages import GeneratePassages
from ..operators.tokenizer import RegexTokenizer, TokenizerPipe
from ..search.bm25 import Bm25Config, Bm25Search, auxiliary_weight
from ..search.dense import DenseConfig, DenseSearch
from ..search.lookup import GroupLookupConfig, GroupLookupSearch, TopkConfig, TopkSearch
from ..search.result import by_query, merge_results, sum_scores, to_wide, top_k

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(found: DataFrame, *extra: str) -> DataFrame:
    return found.select(*extra, "qid", "idx", F.round("score", 5).alias("score"))


# --- vector search


def _dense(spark, sf_dir, **config) -> tuple[DenseSearch, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("__idx__"), c("embedding").alias("index.vector"), c("embedding").alias("query.vector"))
    engine = DenseSearch(DenseConfig(**config)).build(vectors.select("__idx__", c("index.vector")))
    return engine, vectors.select("__idx__", c("query.vector"))


_PAIRS = "SELECT a.vec_id AS qid, b.vec_id AS idx, {score} AS s FROM embeddings a, embeddings b"
_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_TOP = "QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, idx) <= {k}"


@query(f"WITH p AS ({_PAIRS.format(score=_DOT)} {_TOP.format(k=10)}) SELECT qid, idx, round(s, 5) AS score FROM p")
def dense_topk(spark, sf_dir):
    engine, queries = _dense(spark, sf_dir, k=10)
    return rounded(engine.search(queries))


@query(f"WITH p AS ({_PAIRS.format(score='-(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2)')} {_TOP.format(k=5)}) SELECT qid, idx, round(s, 4) + 0.0 AS score FROM p")
def dense_l2(spark, sf_dir):
    engine, queries = _dense(spark, sf_dir, k=5, metric="l2")
    return engine.search(queries).select("qid", "idx", (F.round("score", 4) + F.lit(0.0)).alias("score"))


@query(f"WITH p AS ({_PAIRS.format(score=_DOT)} {_TOP.format(k=5)}) SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY s DESC, idx)::INTEGER AS place, round(s, 5) AS score FROM p")
def dense_then_rerank(spark, sf_dir):
    engine, queries = _dense(spark, sf_dir, k=10)
    found = TopkSearch(TopkConfig(k=5), update=True).transform(engine.dataset(queries))
    pairs = F.posexplode(F.arrays_zip(c("index.idx").alias("idx"), c("index.score").alias("score")).cast("array<struct<idx:bigint,score:double>>")).alias("p", "h")
    rows = found.select(c("__idx__").alias("qid"), pairs).filter("h.idx >= 0")
    return rows.select("qid", c("h")["idx"].alias("idx"), (c("p") + 1).alias("place"), F.round(c("h")["score"], 5).alias("score"))


@query(f"WITH p AS ({_PAIRS.format(score=_DOT)} {_TOP.format(k=10)}) SELECT qid, idx, round(s, 5) AS score FROM p")
def ivf_search(spark, sf_dir):
    """All lists are looked into, so the result is that of an exact search."""
    engine, queries = _dense(spark, sf_dir, k=10, factory="IVF16,Flat", nprobe=16)
    return rounded(engine.search(queries))


# --- text search

_BM25 = r"""
WITH d AS (SELECT doc_id AS idx, {kind} AS kind, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM documents),
m AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM d),
p AS (SELECT term, idx, kind, dl, count(*) AS tf FROM (SELECT idx, kind, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, ln(1 + ((SELECT n FROM m) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p GROUP BY term),
q AS ({queries}),
s AS (SELECT qid, idx, round(sum(w * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT mean FROM m)))), 9) AS s
  FROM (SELECT qid, kind, term, sum(w) AS w FROM q GROUP BY ALL) JOIN f USING (term) JOIN p USING (term, kind) WHERE w > 0 GROUP BY qid, idx)
SELECT qid, idx, round(s, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, idx) <= {k}"""
_TERMS = r"unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')) AS term"
_ASKED = "SELECT item_id AS qid, 0 AS kind, 1.0::DOUBLE AS w, " + _TERMS.format(text="text") + " FROM benchmark"


def _bm25(spark, sf_dir, queries: DataFrame, **config) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(c("doc_id").alias("__idx__"), c("text").alias("index.text"), c("lang").alias("index.lang"))
    engine = Bm25Search(Bm25Config(**config)).build(docs)
    return rounded(engine.search(queries))


def _asked(spark, sf_dir, *extra) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(c("item_id").alias("__idx__"), c("text").alias("query.text"), *extra)


@query(_BM25.format(kind="0", queries=_ASKED, k=10))
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, _asked(spark, sf_dir), k=10)


_AUX = "array_to_string(string_split(text, ' ')[1:4], ' ')"
_COUNT = r"len(list_filter(string_split({text}, ' '), lambda w: trim(regexp_replace(w, '[!-/:-@\[-`{{-~]', '', 'g')) <> ''))"


@query(
    _BM25.format(
        kind="0",
        queries=_ASKED + " UNION ALL SELECT item_id, 0, CASE WHEN a = 0 THEN 0 ELSE 1 + greatest(0.5 * ln(greatest(b / a, 1)), 0) END, " + _TERMS.format(text="aux")
        + f" FROM (SELECT item_id, {_AUX} AS aux, {_COUNT.format(text=_AUX)} AS a, {_COUNT.format(text='text')} AS b FROM benchmark)",
        k=10,
    )
)
def bm25_aux_weighted(spark, sf_dir):
    aux = F.concat_ws(" ", F.slice(F.split("text", " "), 1, 4)).alias("query.aux")
    return _bm25(spark, sf_dir, _asked(spark, sf_dir, aux), k=10, auxiliary_key="aux", auxiliary_weight=0.5)


@query(_BM25.format(kind="lang", queries=_ASKED.replace("0 AS kind", "CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'de' END AS kind"), k=5))
def bm25_filtered(spark, sf_dir):
    lang = F.when(F.col("item_id") % 2 == 0, "en").otherwise("de").alias("query.lang")
    return _bm25(spark, sf_dir, _asked(spark, sf_dir, lang), k=5, filter_key="lang")


@query(f"SELECT item_id, round(CASE WHEN a = 0 THEN 0 ELSE 1 + greatest(0.5 * ln(greatest(b / a, 1)), 0) END, 6) AS beta FROM (SELECT item_id, {_COUNT.format(text=_AUX)} AS a, {_COUNT.format(text='text')} AS b FROM benchmark)")
def auxiliary_weights(spark, sf_dir):
    aux = F.concat_ws(" ", F.slice(F.split("text", " "), 1, 4))
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(auxiliary_weight(F.col("text"), aux, 0.5), 6).alias("beta"))


# --- groups and result algebra


def _lookup(spark, sf_dir, k) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("__idx__"), c("l_orderkey").alias("index.group_idx"))
    orders = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("__idx__"), c("o_orderkey").alias("query.group_idx"))
    return GroupLookupSearch(GroupLookupConfig(k=k)).build(lines).search(orders)


_LOOKUP = "SELECT o_orderkey AS qid, l_orderkey * 10 + l_linenumber AS idx, 0.0::DOUBLE AS score FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query(_LOOKUP)
def group_lookup(spark, sf_dir):
    return _lookup(spark, sf_dir, None)


@query(f"{_LOOKUP} QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY idx) <= 2")
def group_lookup_topk(spark, sf_dir):
    return _lookup(spark, sf_dir, 2)


_SIDES = """a AS (SELECT l_orderkey AS qid, l_suppkey AS idx, sum(l_quantity) AS s FROM lineitem GROUP BY ALL),
b AS (SELECT l_orderkey AS qid, l_suppkey AS idx, sum(l_tax * 100) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)"""


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("qid"), c("l_suppkey").alias("idx"), "l_quantity", "l_tax", "l_returnflag")
    side = lambda df, v: by_query(df).groupBy("qid", "idx").agg(F.sum(v).alias("score"))
    return side(lines, F.col("l_quantity")), side(lines.filter("l_returnflag = 'R'"), F.col("l_tax") * 100)


@query(f"""WITH {_SIDES}, la AS (SELECT qid, min(s) AS m FROM a GROUP BY qid), lb AS (SELECT qid, min(s) AS m FROM b GROUP BY qid),
u AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.idx, b.idx) AS idx, a.s AS x, b.s AS y FROM a FULL JOIN b ON a.qid = b.qid AND a.idx = b.idx)
SELECT u.qid, u.idx, round(coalesce(x, la.m, 0) + coalesce(y, lb.m, 0), 5) AS score FROM u LEFT JOIN la ON u.qid = la.qid LEFT JOIN lb ON u.qid = lb.qid""")
def merge_search_results(spark, sf_dir):
    return rounded(merge_results(*_sides(spark, sf_dir)))


@query(f"WITH {_SIDES} SELECT qid, idx, round(sum(s), 5) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY qid, idx")
def sum_search_scores(spark, sf_dir):
    return rounded(sum_scores(*_sides(spark, sf_dir)))


@query(f"""WITH {_SIDES}, t AS (SELECT qid, idx, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, idx) AS r FROM a QUALIFY r <= 4),
g AS (SELECT qid, list(idx ORDER BY r) AS i, list(s ORDER BY r) AS s FROM t GROUP BY qid), k AS (SELECT unnest([0, 1, 2, 3]) AS p)
SELECT qid, p AS place, coalesce(i[p + 1], -1) AS idx, s[p + 1] IS NULL AS missing FROM g, k""")
def resize_and_pad(spark, sf_dir):
    wide = to_wide(_sides(spark, sf_dir)[0], 4)
    rows = wide.select("qid", F.posexplode(F.arrays_zip("idx", "score")).alias("place", "h"))
    return rows.select("qid", "place", c("h")["idx"].alias("idx"), (c("h")["score"] == F.lit(float("-inf"))).alias("missing"))


# --- tokens and passages

_WORDS = r"regexp_extract_all(text, '\S+')"


def _words(text="text"):
    return F.regexp_extract_all(F.col(text), F.lit(r"(\S+)"), 1)


_WINDOWS = f"""WITH t AS (SELECT doc_id, len({_WORDS}) AS n FROM documents),
w AS (SELECT doc_id, n, i // 80 AS passage, i FROM (SELECT doc_id, n, unnest(range(0, n, 80)) AS i FROM t)),
v AS (SELECT *, CASE WHEN i > 0 THEN 10 ELSE 0 END AS lo, least(100, n - i) AS size FROM w)"""


@query(f"{_WINDOWS} SELECT doc_id, passage, size AS n_words, CASE WHEN size > lo THEN least(size, 90) - lo ELSE 0 END AS n_owned FROM v WHERE size > lo")
def passages(spark, sf_dir):
    # words are a column of their own: a lambda would find them again for every window
    windows = gen_passages(F.col("words"), "string", size=100, stride=80)
    rows = table(spark, sf_dir, "documents").select("doc_id", _words().alias("words")).select("doc_id", F.posexplode(windows).alias("passage", "w"))
    owned = F.aggregate(c("w")["mask"], F.lit(0).cast("bigint"), lambda s, x: s + x)
    return rows.select("doc_id", F.col("passage").cast("bigint").alias("passage"), F.size(c("w")["tokens"]).cast("bigint").alias("n_words"), owned.alias("n_owned"))


@query(f"SELECT doc_id, len({_WORDS}) AS n_owned FROM documents WHERE len({_WORDS}) > 0")
def passage_mask_coverage(spark, sf_dir):
    """Every word is owned by one passage."""
    windows = gen_passages(F.col("words"), "string", size=32, stride=20, start_tokens=["<s>"], pad_token="<pad>")
    rows = table(spark, sf_dir, "documents").select("doc_id", _words().alias("words")).select("doc_id", F.explode(windows).alias("w"))
    return rows.groupBy("doc_id").agg(F.sum(F.aggregate(c("w")["mask"], F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("n_owned"))


_RE = RegexTokenizer(r"\w+")


@query(r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w, len(regexp_extract_all(source, '[\p{L}\p{N}_]+')) + 1 AS before FROM documents),
v AS (SELECT doc_id, len(w) AS n, 48 - before AS inside, 36 - before AS step, before FROM t),
x AS (SELECT doc_id, n, inside, step, unnest(range(0, n, step)) AS i FROM v WHERE n > 0)
SELECT doc_id, i // step AS passage, 48 AS n_ids, least(inside, n - i) AS n_words FROM x WHERE least(inside, n - i) > CASE WHEN i > 0 THEN 6 ELSE 0 END""")
def passages_with_title(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(c("doc_id").alias("document.doc_id"), c("text").alias("document.text"), c("source").alias("title.text"))
    tokenized = pipelines.Parallel(
        TokenizerPipe(_RE, field="document", return_offsets_mapping=True), TokenizerPipe(_RE, field="title"), update=True
    ).transform(docs)
    cut = GeneratePassages(size=48, stride=36, field="document", prepend_field="title", start_tokens=[0], global_keys=["doc_id"]).transform(tokenized)
    words = F.size(F.filter(c("document.offset_mapping"), lambda x: x[0] >= 0)).cast("bigint")
    return cut.select(c("document.doc_id").alias("doc_id"), c("document.passage_idx").alias("passage"), F.size(c("document.input_ids")).alias("n_ids"), words.alias("n_words"))


@query(r"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)")
def tokenize_counts(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"))


@query(r"SELECT conv_id, turn, len(w) AS n_tokens, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS covered FROM (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM conversations)")
def tokenize_offsets(spark, sf_dir):
    rows = TokenizerPipe(_RE, return_offsets_mapping=True)(table(spark, sf_dir, "conversations"))
    covered = F.aggregate("offset_mapping", F.lit(0).cast("bigint"), lambda s, x: s + x[1] - x[0])
    return rows.select("conv_id", "turn", F.size("input_ids").cast("bigint").alias("n_tokens"), covered.alias("covered"))


# --- arrays and nesting


def _orders(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey"))).alias("rows"))
    return lines.select("l_orderkey", c("rows").getField("l_quantity").alias("quantity"), c("rows").getField("l_partkey").alias("part"))


@query("SELECT l_orderkey, l_linenumber - min(l_linenumber) OVER (PARTITION BY l_orderkey) AS place, l_quantity * 2 AS quantity, l_partkey + 1 AS part FROM (SELECT l_orderkey, l_quantity, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey)::INTEGER AS l_linenumber FROM lineitem)")
def apply_as_flatten(spark, sf_dir):
    pipe = nesting.ApplyAsFlatten(basics.Apply({"quantity": lambda x: x * 2, "part": lambda x: x + 1}), level=1, input_filter=In(["quantity", "part"]), update=True)
    rows = pipe.transform(_orders(spark, sf_dir))
    return rows.select("l_orderkey", F.posexplode(F.arrays_zip("quantity", "part")).alias("place", "r")).select("l_orderkey", "place", "r.quantity", "r.part")


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC)::INTEGER - 1 AS place, l_quantity AS quantity FROM lineitem")
def nested_sort(spark, sf_dir):
    pipe = nesting.Nested(lambda cols: {k: F.sort_array(v, asc=False) for k, v in cols.items()}, level=1, input_filter=In(["quantity"]), update=True)
    return pipe.transform(_orders(spark, sf_dir)).select("l_orderkey", F.posexplode("quantity").alias("place", "quantity"))


@query("SELECT l_orderkey, count(*) FILTER (l_quantity < 25) AS n, coalesce(sum(l_quantity) FILTER (l_quantity < 25), 0) AS total FROM lineitem GROUP BY l_orderkey")
def nested_filter(spark, sf_dir):
    pipe = nesting.Nested(lambda cols: {k: F.filter(v, lambda x: x < 25) for k, v in cols.items()}, level=1, input_filter=In(["quantity"]), update=True)
    total = F.aggregate("quantity", F.lit(0.0), lambda s, x: s + x)
    return pipe.transform(_orders(spark, sf_dir)).select("l_orderkey", F.size("quantity").cast("bigint").alias("n"), total.alias("total"))


@query("SELECT vec_id, i AS place, round(embedding[i + 1]::DOUBLE, 6) AS value FROM embeddings, range(64) t(i)")
def flatten_nest_roundtrip(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", arrays.flatten_nested(arrays.nested(F.col("embedding"), [4, -1, 2]), 2).alias("v"))
    return v.select("vec_id", F.posexplode("v").alias("place", "value")).select("vec_id", F.col("place").cast("bigint").alias("place"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query("SELECT row AS parent, array_agg(vec_id ORDER BY vec_id) AS members FROM (SELECT vec_id, vec_id // 4 AS row FROM embeddings) GROUP BY row")
def nest_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("__idx__"), "vec_id")
    return nesting.Nest([-1, 4]).transform(rows.filter("vec_id IS NOT NULL"), shape=[1, 4]).select(c("__idx__").alias("parent"), c("vec_id").alias("members"))


@query("SELECT vec_id, i AS place, j AS copy, round(embedding[i + 1]::DOUBLE, 6) AS value FROM embeddings, range(64) t(i), range(2) u(j)")
def expand_axis(spark, sf_dir):
    v = nesting.Expand(-1, 2, input_filter=In(["embedding"]), update=True).transform(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = v.select("vec_id", F.posexplode("embedding").alias("place", "v")).select("vec_id", "place", F.posexplode("v").alias("copy", "value"))
    return rows.select("vec_id", F.col("place").cast("bigint").alias("place"), F.col("copy").cast("bigint").alias("copy"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query("WITH d AS (SELECT DISTINCT l_orderkey, l_quantity AS q FROM lineitem), g AS (SELECT l_orderkey, list(q ORDER BY q) AS q FROM d GROUP BY l_orderkey) SELECT l_orderkey, i AS place, coalesce(q[i + 1], -1) AS quantity FROM g, range(3) t(i)")
def unique_pad(spark, sf_dir):
    v = _orders(spark, sf_dir).select("l_orderkey", arrays.pad_to_length(arrays.unique(F.col("quantity")), 3, -1.0).alias("q"))
    return v.select("l_orderkey", F.posexplode("q").alias("place", "quantity")).select("l_orderkey", F.col("place").cast("bigint").alias("place"), "quantity")


# --- columns and control flow


@query("SELECT c_custkey AS \"key\", c_name AS name FROM customer")
def rename_keys(spark, sf_dir):
    return basics.RenameKeys({"c_custkey": "key", "c_name": "name", "c_none": "x"}).transform(table(spark, sf_dir, "customer"))


@query("SELECT c_custkey AS cust_custkey, c_nationkey AS cust_nationkey FROM customer")
def filter_and_prefix(spark, sf_dir):
    pipe = pipelines.Sequential(
        basics.FilterKeys(Reduce(HasPrefix("c_"), Not(In(["c_name"])), Contains("key"))), basics.ReplaceInKeys("c_", ""), basics.AddPrefix("cust_")
    )
    return pipe.transform(table(spark, sf_dir, "customer"))


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def drop_keys(spark, sf_dir):
    return basics.DropKeys(keys=["s_acctbal"], condition=Contains("name")).transform(table(spark, sf_dir, "supplier"))


@query("SELECT c_custkey, c_acctbal * 2 AS acctbal, upper(c_name) AS name FROM customer")
def parallel_by_field(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", c("c_acctbal").alias("money.acctbal"), c("c_name").alias("text.name"))
    pipe = pipelines.ParallelbyField({"money": basics.ApplyToAll(lambda x: x * 2), "text": basics.ApplyToAll(F.upper)}, update=True)
    return pipe.transform(rows).select("c_custkey", c("money.acctbal").alias("acctbal"), c("text.name").alias("name"))


@query("SELECT s_name FROM supplier")
def gate_on_keys(spark, sf_dir):
    return pipelines.Gate(HasKeys(["s_none"]), basics.GetKey("s_none"), basics.GetKey("s_name")).transform(table(spark, sf_dir, "supplier"))


# --- batches


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role || ':' || text, '|' ORDER BY turn, role, text) AS said FROM conversations GROUP BY conv_id")
def collate_conversation(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    said = F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    return rows.select("conv_id", F.size("rows").cast("bigint").alias("n_turns"), F.array_join(said, "|").alias("said"))


@query(r"SELECT conv_id, turn, max(len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) OVER () AS width, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n_real FROM conversations")
def pad_to_longest(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(c("conv_id").alias("c.conv_id"), c("turn").alias("c.turn"), c("text").alias("c.text"))
    rows = TokenizerPipe(_RE, field="c", update=True).transform(rows)
    out = collate.CollateField("c", tokenizer=_RE, exclude=["text"]).transform(rows)
    real = F.aggregate(c("c.attention_mask"), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return out.select(c("c.conv_id").alias("conv_id"), c("c.turn").alias("turn"), F.size(c("c.input_ids")).cast("bigint").alias("width"), real.alias("n_real"))


# --- whole tables


@query("SELECT o_orderkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def concat_rows(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), c("o_totalprice").alias("v"))
    return datasets.concatenate_datasets([a, table(spark, sf_dir, "customer").select(c("c_custkey").alias("k"), c("c_acctbal").alias("v"))])


@query("SELECT o_orderkey AS k, o_totalprice, o_orderpriority FROM orders")
def zip_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k")
    return datasets.concatenate_datasets([orders.select("k", "o_totalprice"), orders.select("k", "o_orderpriority")], axis=1, key="k")


@query()
def take_subset(spark, sf_dir):
    return datasets.take_subset(table(spark, sf_dir, "documents").select("doc_id", "lang"), 0.1, key="doc_id")


def _linear(batch: dict) -> dict:
    x = np.array(batch["embedding"], np.float64)
    weights = (np.arange(64 * 4).reshape(64, 4) % 7 - 3) / 8
    return {"vector": x @ weights}


_LINEAR = "SELECT vec_id, j AS place, round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * (((i * 4 + j) % 7) - 3) / 8)), 4) + 0.0 AS value FROM embeddings, range(4) t(j)"


def _exploded(vectors: DataFrame) -> DataFrame:
    rows = vectors.select("vec_id", F.posexplode("vector").alias("place", "value"))
    return rows.select("vec_id", F.col("place").cast("bigint").alias("place"), (F.round("value", 4) + F.lit(0.0)).alias("value"))


@query(_LINEAR)
def predict_linear(spark, sf_dir):
    model = predict.PredictWithoutCache(_linear, kind="array<double>", input_filter=In(["embedding"]), update=True)
    return _exploded(model.transform(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


@query("SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY s DESC, idx)::INTEGER AS rank FROM (SELECT l_orderkey AS qid, l_partkey AS idx, sum(l_quantity) AS s FROM lineitem GROUP BY ALL) QUALIFY rank <= 3")
def topk_rerank(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("qid"), c("l_partkey").alias("idx")).agg(F.sum("l_quantity").alias("score"))
    return top_k(lines, 3).drop("score")
