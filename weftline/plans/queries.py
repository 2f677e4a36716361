"""The workflow queries of ``__spark_entry__``, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import codec, identity
from weftline.functions import text
from weftline.operators import dynamic, graph, results, shell
from weftline.plans.parametric import Plans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NL = "chr(10)"
CONST = "sha1('artefact'||chr(10)||'constant'||chr(10)||'kind:Encoding.blob'||chr(10)||{})"
EDGES = """
SELECT DISTINCT p, c FROM (
  SELECT 'r:'||r_regionkey AS p, 'n:'||n_nationkey AS c FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'n:'||c_nationkey, 'c:'||c_custkey FROM customer
  UNION ALL SELECT 'n:'||s_nationkey, 's:'||s_suppkey FROM supplier
  UNION ALL SELECT 'c:'||o_custkey, 'o:'||o_orderkey FROM orders
  UNION ALL SELECT 'o:'||l_orderkey, 'l:'||l_orderkey||':'||l_linenumber FROM lineitem
  UNION ALL SELECT 's:'||l_suppkey, 'l:'||l_orderkey||':'||l_linenumber FROM lineitem
  UNION ALL SELECT 'p:'||l_partkey, 'l:'||l_orderkey||':'||l_linenumber FROM lineitem)
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ sources and identity
def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", identity.constant_column("blob", F.col("text")).alias("h"))


_HASHED = f"SELECT doc_id, {CONST.format('text')} AS h FROM documents"


@query(_HASHED)
def put_const_hash(spark, sf_dir):
    return _hashed(spark, sf_dir)


@query(f"SELECT h, count(*) AS copies, min(doc_id) AS first_doc FROM ({_HASHED}) GROUP BY h")
def put_dedup(spark, sf_dir):
    return _hashed(spark, sf_dir).groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


@query(
    f"""
WITH k AS (SELECT n_nationkey, {CONST.format('n_name')} AS const_hash FROM nation),
f AS (SELECT sha1('funsiehow=0'||{NL}||'what=morph:upper'||{NL}||'input:in0 -> blob'||{NL}||'output:out0 -> blob'||{NL}||'error tolerant:0'||{NL}) AS fh),
o AS (SELECT n_nationkey, const_hash, sha1('op'||fh||'file=in0, hash=Artefact(hash='''||const_hash||''', parent=''root'', kind=<Encoding.blob: ''blob''>)') AS op_hash FROM k, f)
SELECT n_nationkey, const_hash, op_hash, sha1('artefact'||{NL}||'variable'||{NL}||'kind:Encoding.blob'||{NL}||'parent:'||op_hash||{NL}||'name:out0'||{NL}) AS out_hash FROM o
"""
)
def merkle_op_hash(spark, sf_dir):
    step = identity.function(0, "morph:upper", {"in0": "blob"}, {"out0": "blob"}, False)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", identity.constant_column("blob", F.col("n_name")).alias("const_hash"))
    rows = rows.withColumn("op_hash", identity.operation_column(step, {"in0": identity.handle_column(F.col("const_hash"), F.lit(identity.ROOT), "blob")}))
    return rows.withColumn("out_hash", identity.variable_column("blob", F.col("op_hash"), "out0"))


@query(f"SELECT doc_id, left(h, 6) AS short FROM ({_HASHED})")
def short_hash(spark, sf_dir):
    return _hashed(spark, sf_dir).select("doc_id", identity.short(F.col("h")).alias("short"))


@query(f"SELECT doc_id, h FROM ({_HASHED}) WHERE starts_with(h, 'a')")
def prefix_lookup(spark, sf_dir):
    return _hashed(spark, sf_dir).filter(F.col("h").startswith("a"))


@query(f"SELECT doc_id, h[1:2]||'/'||h[3:] AS path FROM ({_HASHED})")
def disk_shard_path(spark, sf_dir):
    return _hashed(spark, sf_dir).select("doc_id", identity.shard_path(F.col("h")).alias("path"))


@query(
    """
WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)
SELECT doc_id, i AS block, least(64, n - i * 64)::BIGINT AS n_bytes
FROM (SELECT doc_id, n, unnest(generate_series(0, greatest(ceil(n / 64)::BIGINT, 1) - 1)) AS i FROM d)
"""
)
def chunk_blocks(spark, sf_dir):
    blocks = text.chunks(F.encode("text", "UTF-8"), 64)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(blocks).alias("block", "chunk"))
    return rows.select("doc_id", F.col("block").cast("long").alias("block"), F.octet_length("chunk").cast("long").alias("n_bytes"))


# ------------------------------------------------------------------ encodings
@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_decode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", codec.decode_json(F.col("props"), "$.k", "bigint").alias("k"))


@query("SELECT event_id, to_json({'e': event_type, 'u': user_id, 'v': value})::VARCHAR AS j FROM events")
def json_encode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", codec.encode_json(F.struct(F.col("event_type").alias("e"), F.col("user_id").alias("u"), F.col("value").alias("v"))).alias("j"))


@query("SELECT doc_id, CASE WHEN NOT json_valid(text) THEN 'JSONDecodingError' END AS err FROM documents")
def json_decode_error(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", codec.decoded(F.col("text"), "doc")["error"]["kind"].alias("err"))


@query("SELECT doc_id, 'json' AS of_text, 'blob' AS of_bytes FROM documents")
def kind_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", codec.kind_column(F.col("text")).alias("of_text"), codec.kind_column(F.encode("text", "UTF-8")).alias("of_bytes"))


# ------------------------------------------------------------------ functions over values
@query("SELECT n_nationkey, upper(n_name) AS v FROM nation")
def morph_upper(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", results.strict(F.upper, results.ok(F.col("n_name")))["value"].alias("v"))


@query("SELECT n_nationkey, upper(n_name) AS out0, lower(n_name) AS out1 FROM nation")
def py_multi_output(spark, sf_dir):
    both = results.strict(lambda x: F.struct(F.upper(x).alias("out0"), F.lower(x).alias("out1")), results.ok(F.col("n_name")))
    return table(spark, sf_dir, "nation").select("n_nationkey", both["value"].alias("s")).select("n_nationkey", "s.*")


@query("SELECT n_nationkey, upper(n_name)||r_name||'|wat' AS v FROM nation JOIN region ON n_regionkey = r_regionkey")
def reduce_join(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # region: one row per continent
    parts = [results.strict(F.upper, results.ok(F.col("n_name"))), results.ok(F.col("r_name")), results.ok(F.lit("|wat"))]
    return rows.select("n_nationkey", results.strict(lambda *vs: F.concat(*vs), *parts)["value"].alias("v"))


@query("SELECT o_orderkey, o_orderkey + o_custkey AS v FROM orders")
def reduce_sum(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", results.strict(lambda a, b: a + b, results.ok(F.col("o_orderkey")), results.ok(F.col("o_custkey")))["value"].alias("v"))


def _values(spark: SparkSession, sf_dir: str, limit: float = 300) -> DataFrame:
    """event_id, user_id, event_type, r: the value, or an error above ``limit``."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", results.stop_if(results.ok(F.col("value")), lambda v: v > limit).alias("r"))


@query("SELECT event_id, CASE WHEN value <= 300 THEN value END AS v, CASE WHEN value > 300 THEN 'ExceptionRaised' END AS err FROM events")
def stop_if(spark, sf_dir):
    return _values(spark, sf_dir).select("event_id", F.col("r.value").alias("v"), F.col("r.error.kind").alias("err"))


@query("SELECT doc_id, CASE WHEN lang <> 'en' THEN octet_length(encode(text))::BIGINT END AS n, CASE WHEN lang = 'en' THEN 'ExceptionRaised' END AS err FROM documents")
def not_empty(spark, sf_dir):
    given = results.ok(F.when(F.col("lang") == "en", "").otherwise(F.col("text")))
    r = results.strict(lambda v: F.octet_length(v).cast("long"), results.not_empty(given))
    return table(spark, sf_dir, "documents").select("doc_id", r["value"].alias("n"), r["error"]["kind"].alias("err"))


@query("SELECT doc_id, CASE WHEN toxic = 0 THEN quality END AS v, CASE WHEN toxic <> 0 THEN 'toxic' END AS source FROM labels")
def barrier(spark, sf_dir):
    condition = results.guard(F.col("toxic"), F.col("toxic") != 0, "ExceptionRaised", "toxic")
    r = results.barrier(results.ok(F.col("quality")), condition)
    return table(spark, sf_dir, "labels").select("doc_id", r["value"].alias("v"), r["error"]["source"].alias("source"))


def _turns() -> Column:
    return results.guard(F.char_length("text"), F.col("role") == "system", "NotFound", "turn")


@query("SELECT conv_id, coalesce(string_agg(CASE WHEN role <> 'system' THEN length(text)::VARCHAR END, ',' ORDER BY turn), '') AS v FROM conversations GROUP BY conv_id")
def match_drop(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(dynamic.ordered(_turns(), F.col("turn")).alias("rs"))
    return rows.select("conv_id", F.array_join(results.match_results(F.col("rs"), lambda v: v.cast("string")), ",").alias("v"))


@query("SELECT conv_id, string_agg(CASE WHEN role <> 'system' THEN length(text)::VARCHAR ELSE 'NotFound' END, ',' ORDER BY turn) AS v FROM conversations GROUP BY conv_id")
def match_map(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(dynamic.ordered(_turns(), F.col("turn")).alias("rs"))
    return rows.select("conv_id", F.array_join(results.match_results(F.col("rs"), lambda v: v.cast("string"), lambda e: e["kind"]), ",").alias("v"))


@query(
    """
SELECT event_id, CASE WHEN value > 300 THEN 'a' WHEN user_id % 7 = 0 THEN 'b' END AS source,
       CASE WHEN NOT (value > 300 OR user_id % 7 = 0) THEN round(value + user_id, 4) END AS v FROM events
"""
)
def strict_gate(spark, sf_dir):
    a = results.guard(F.col("value"), F.col("value") > 300, "ExceptionRaised", "a")
    b = results.guard(F.col("user_id"), F.col("user_id") % 7 == 0, "ExceptionRaised", "b")
    r = results.strict(lambda x, y: F.round(x + y, 4), a, b)
    return table(spark, sf_dir, "events").select("event_id", r["error"]["source"].alias("source"), r["value"].alias("v"))


@query("SELECT event_id, CASE WHEN value > 300 THEN 'error:ExceptionRaised' ELSE 'value:'||event_type END AS v FROM events")
def take_lax(spark, sf_dir):
    rows = _values(spark, sf_dir)
    return rows.select("event_id", results.match(F.col("r"), lambda _: F.concat(F.lit("value:"), F.col("event_type")), lambda e: F.concat(F.lit("error:"), e["kind"])).alias("v"))


@query(
    """
SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'NotFound' WHEN toxic = 1 THEN 'Mismatch' WHEN quality = 0 THEN 'UnresolvedLink' END AS err,
       CASE WHEN quality = 1 AND toxic = 0 THEN n_chars END AS v FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
)
def status_to_result(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, 3).when(F.col("quality") == 0, 4).when(F.col("quality") == 1, 1)
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels.select("doc_id", status.alias("status")), "doc_id", "left")
    r = results.from_status(F.col("status"), F.col("n_chars"), results.error("Mismatch", F.col("doc_id")), F.col("doc_id"))
    return rows.select("doc_id", r["error"]["kind"].alias("err"), r["value"].alias("v"))


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount <> 0 THEN round(10.0::DOUBLE / l_discount, 6) END AS v,
       CASE WHEN l_discount = 0 THEN 'ExceptionRaised' END AS err FROM lineitem
"""
)
def div_errors(spark, sf_dir):
    r = results.guard(F.round(F.try_divide(F.lit(10.0), F.col("l_discount")), 6), F.col("l_discount") == 0, "ExceptionRaised", "divide")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r["value"].alias("v"), r["error"]["kind"].alias("err"))


@query("SELECT event_id, nullif(event_type, 'click') AS v, CASE WHEN event_type = 'click' THEN 'MissingOutput' END AS err FROM events")
def missing_output(spark, sf_dir):
    r = results.missing_output(F.nullif(F.col("event_type"), F.lit("click")), "pick")
    return table(spark, sf_dir, "events").select("event_id", r["value"].alias("v"), r["error"]["kind"].alias("err"))


@query(
    """
SELECT event_id, CASE WHEN value <= 300 THEN round(value * 2 + json_extract(props, '$.k')::BIGINT, 4) END AS v,
       CASE WHEN value > 300 THEN 'ExceptionRaised' END AS err, CASE WHEN value > 300 THEN 'stop_if' END AS source FROM events
"""
)
def error_propagation(spark, sf_dir):
    """Decode, stop above 300, double, add: an error keeps its source through the later steps."""
    k = results.missing_output(codec.decode_json(F.col("props"), "$.k", "bigint"), "decode")
    stopped = results.stop_if(results.ok(F.col("value")), lambda v: v > 300)
    doubled = results.strict(lambda v: v * 2, stopped)
    summed = results.strict(lambda a, b: F.round(a + b, 4), doubled, k)
    return table(spark, sf_dir, "events").select("event_id", summed["value"].alias("v"), summed["error"]["kind"].alias("err"), summed["error"]["source"].alias("source"))


@query("SELECT event_id, CASE WHEN value <= 300 THEN round(value, 4) ELSE -1 END AS v FROM events")
def error_lax(spark, sf_dir):
    rows = _values(spark, sf_dir)
    return rows.select("event_id", results.lax(lambda r: F.when(r["error"].isNull(), F.round(r["value"], 4)).otherwise(-1.0), F.col("r"))["value"].alias("v"))


@query("SELECT event_type, count(*) FILTER (value > 300) AS n_errors, count(*) AS n FROM events GROUP BY event_type")
def error_count(spark, sf_dir):
    return _values(spark, sf_dir).groupBy("event_type").agg(F.count_if(results.is_error(F.col("r"))).alias("n_errors"), F.count(F.lit(1)).alias("n"))


@query(
    """
SELECT user_id, count(*) FILTER (value > 480) AS n_errors, min(event_id) FILTER (value > 480) AS first_failed,
       CASE WHEN count(*) FILTER (value > 480) > 0 THEN 'ExceptionRaised' END AS err FROM events GROUP BY user_id
"""
)
def execute_all(spark, sf_dir):
    rows = _values(spark, sf_dir, 480)
    failed = results.is_error(F.col("r"))
    out = rows.groupBy("user_id").agg(F.count_if(failed).alias("n_errors"), F.min_by(F.struct("event_id", "r.error"), F.when(failed, F.col("event_id"))).alias("f"))
    out = out.withColumn("f", F.when(F.col("n_errors") > 0, F.col("f")))
    return out.select("user_id", "n_errors", F.col("f.event_id").alias("first_failed"), F.col("f.error.kind").alias("err"))


# ------------------------------------------------------------------ text
@query("SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS t FROM conversations GROUP BY conv_id")
def concat_rows(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(text.concat_rows(F.col("text"), F.col("turn"), "|").alias("t"))


@query("SELECT conv_id, string_agg(trim(text, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '|' ORDER BY turn) AS t FROM conversations GROUP BY conv_id")
def concat_strip(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(text.concat_rows(F.col("text"), F.col("turn"), "|", strip_each=True).alias("t"))


@query("SELECT conv_id, coalesce(string_agg(CASE WHEN role <> 'system' THEN text END, '|' ORDER BY turn), '') AS t FROM conversations GROUP BY conv_id")
def concat_lax(spark, sf_dir):
    r = results.guard(F.col("text"), F.col("role") == "system", "NotFound", "turn")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(text.concat_rows(r["value"], F.col("turn"), "|").alias("t"))


@query(
    """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
e AS (SELECT doc_id, p, len(p) - 3 AS j, len(p) AS n FROM d),
f AS (SELECT doc_id, p, CASE WHEN j < 0 THEN greatest(j + n, 0) ELSE j END AS j FROM e)
SELECT doc_id, CASE WHEN j >= 3 THEN array_to_string(list_slice(p, 3, j), chr(10)) ELSE '' END AS t FROM f
"""
)
def truncate_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 2, 3).alias("t"))


@query("SELECT n_nationkey, 'Nation '||trim(n_name)||' ('||n_nationkey||') of '||trim(r_name)||'.' AS t FROM nation JOIN region ON n_regionkey = r_regionkey")
def template_render(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # region: one row per continent
    filled = text.template("Nation {{name}} ({{id}}) of {{{region}}}.", {"name": F.col("n_name"), "id": F.col("n_nationkey"), "region": F.col("r_name")})
    return rows.select("n_nationkey", filled.alias("t"))


# ------------------------------------------------------------------ split, apply, combine
def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


@query("SELECT doc_id, list_sum([length(x) for x in string_split(text, ' ')])::BIGINT AS v FROM documents")
def sac_sum(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", dynamic.in_row(F.split("text", " "), F.char_length, _sum).alias("v"))


@query("SELECT doc_id, array_to_string([length(x)::VARCHAR for x in string_split(text, ' ')], '-') AS v FROM documents")
def sac_concat(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return dynamic.exploded(docs, ["doc_id"], F.split("text", " "), lambda rows: rows.withColumn("value", F.char_length("part").cast("string")), lambda vs: F.array_join(vs, "-"), "v")


@query("SELECT conv_id, string_agg(turn + length(text)||'', '//' ORDER BY turn) AS v FROM conversations GROUP BY conv_id")
def sac_zip(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(dynamic.ordered(F.col("turn"), F.col("turn")).alias("a"), dynamic.ordered(F.char_length("text").cast("long"), F.col("turn")).alias("b"))
    return rows.select("conv_id", F.array_join(F.transform(F.zip_with("a", "b", lambda x, y: x + y), lambda v: v.cast("string")), "//").alias("v"))


@query("SELECT conv_id, string_agg(list_sum([length(x) for x in string_split(text, ' ')])::VARCHAR, ',' ORDER BY turn) AS v FROM conversations GROUP BY conv_id")
def sac_nested(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(dynamic.ordered(F.col("text"), F.col("turn")).alias("ts"))
    inner = lambda t: dynamic.in_row(F.split(t, " "), F.char_length, _sum).cast("string")
    return turns.select("conv_id", dynamic.in_row(F.col("ts"), inner, lambda vs: F.array_join(vs, ",")).alias("v"))


@query(
    """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)
SELECT doc_id, CASE WHEN list_max([length(x) for x in ws]) <= 25 THEN len(ws)::BIGINT END AS v,
       CASE WHEN list_max([length(x) for x in ws]) > 25 THEN 'ExceptionRaised' END AS err FROM w
"""
)
def sac_error(spark, sf_dir):
    apply = lambda w: results.guard(F.lit(1).cast("long"), F.char_length(w) > 25, "ExceptionRaised", "word")
    r = dynamic.in_row_results(F.split("text", " "), apply, _sum)
    return table(spark, sf_dir, "documents").select("doc_id", r["value"].alias("v"), r["error"]["kind"].alias("err"))


@query("SELECT l_orderkey, array_to_string([x::VARCHAR for x in list_sort(list(round(l_extendedprice * 100)::BIGINT))], ',') AS v FROM lineitem GROUP BY l_orderkey")
def mergesort(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.round(F.col("l_extendedprice") * 100).cast("long"))).alias("xs"))
    return rows.select("l_orderkey", F.array_join(F.transform("xs", lambda x: x.cast("string")), ",").alias("v"))


@query("SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_quantity, l_partkey) AS v FROM lineitem GROUP BY l_orderkey")
def sort_by_energy(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_quantity", "l_partkey"))).alias("xs"))
    return rows.select("l_orderkey", F.array_join(F.transform("xs", lambda x: x["l_partkey"].cast("string")), ",").alias("v"))


# ------------------------------------------------------------------ graphs
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The foreign keys as steps and their dependencies."""

    def pairs(name: str, parent: tuple[str, str], *child: str) -> DataFrame:
        node = F.concat_ws(":", F.lit(child[0]), *(F.col(c) for c in child[1:]))
        return table(spark, sf_dir, name).select(F.concat_ws(":", F.lit(parent[0]), F.col(parent[1])).alias("parent"), node.alias("child"))

    lines = table(spark, sf_dir, "lineitem")
    needs = F.array(*[F.concat_ws(":", F.lit(kind), F.col(c)) for kind, c in (("o", "l_orderkey"), ("s", "l_suppkey"), ("p", "l_partkey"))])
    line = F.concat_ws(":", F.lit("l"), "l_orderkey", "l_linenumber")
    out = pairs("nation", ("r", "n_regionkey"), "n", "n_nationkey")
    for part in (
        pairs("customer", ("n", "c_nationkey"), "c", "c_custkey"),
        pairs("supplier", ("n", "s_nationkey"), "s", "s_suppkey"),
        pairs("orders", ("c", "o_custkey"), "o", "o_orderkey"),
        lines.select(F.explode(needs).alias("parent"), line.alias("child")).distinct(),
    ):
        out = out.unionByName(part)
    return out


def nodes(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "n string")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat_ws(":", F.lit("l"), "l_orderkey", "l_linenumber").alias("n")).distinct()


_LINES = "SELECT DISTINCT 'l:'||l_orderkey||':'||l_linenumber AS n FROM lineitem"
_UP = "a(n) AS ({start} UNION SELECT e.p FROM e JOIN a ON e.c = a.n)"
_DOWN = "d(n) AS ({start} UNION SELECT e.c FROM e JOIN d ON e.p = d.n)"
_LEVELS = "lv(n, level) AS ({start} UNION SELECT e.c, level + 1 FROM e JOIN lv ON e.p = lv.n)"


@query(f"SELECT p AS parent, c AS child FROM ({EDGES})")
def op_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"WITH RECURSIVE e AS ({EDGES}), {_UP.format(start=_LINES)} SELECT n FROM a WHERE NOT starts_with(n, 'l:')")
def ancestors(spark, sf_dir):
    return graph.ancestors(edges(spark, sf_dir), _lines(spark, sf_dir))


@query(f"WITH RECURSIVE e AS ({EDGES}), {_DOWN.format(start=chr(39).join(['SELECT ', 'n:0', '']))} SELECT n FROM d WHERE n <> 'n:0'")
def descendants(spark, sf_dir):
    return graph.descendants(edges(spark, sf_dir), nodes(spark, "n:0"))


@query("SELECT 'n:'||n_nationkey AS address, 'r:'||n_regionkey AS op FROM nation UNION ALL SELECT 'r:'||r_regionkey, NULL FROM region")
def nearest_op(spark, sf_dir):
    """Of an artefact its parent step; constants have none."""
    nation = table(spark, sf_dir, "nation").select(F.concat_ws(":", F.lit("n"), "n_nationkey").alias("address"), F.concat_ws(":", F.lit("r"), "n_regionkey").alias("parent"))
    region = table(spark, sf_dir, "region").select(F.concat_ws(":", F.lit("r"), "r_regionkey").alias("address"), F.lit(identity.ROOT).alias("parent"))
    return nation.unionByName(region).select("address", F.nullif(F.col("parent"), F.lit(identity.ROOT)).alias("op"))


@query(
    f"""
WITH RECURSIVE e AS ({EDGES}), {_UP.format(start=_LINES)}, k AS (SELECT c, count(DISTINCT p) AS m FROM e GROUP BY c)
SELECT n, coalesce(m, 0)::BIGINT AS pending FROM a LEFT JOIN k ON k.c = a.n
"""
)
def build_dag(spark, sf_dir):
    return graph.build_dag(edges(spark, sf_dir), _lines(spark, sf_dir))


@query(f"SELECT c AS child, count(DISTINCT p) AS pending FROM ({EDGES}) GROUP BY c")
def dependency_counts(spark, sf_dir):
    return graph.dependency_counts(edges(spark, sf_dir))


@query(f"WITH e AS ({EDGES}) SELECT DISTINCT p AS n FROM e WHERE p NOT IN (SELECT c FROM e)")
def dag_roots(spark, sf_dir):
    return graph.roots(edges(spark, sf_dir))


@query(f"WITH RECURSIVE e AS ({EDGES}), {_UP.format(start=_LINES)} SELECT DISTINCT c AS n FROM e JOIN a ON e.c = a.n WHERE p = 'n:0'")
def dag_dependents(spark, sf_dir):
    all_edges = edges(spark, sf_dir)
    return graph.dag_dependents(all_edges, graph.build_dag(all_edges, _lines(spark, sf_dir)), "n:0")


_ROOTS = "SELECT DISTINCT p AS n, 0 AS level FROM e WHERE p NOT IN (SELECT c FROM e)"


@query(f"WITH RECURSIVE e AS ({EDGES}), {_LEVELS.format(start=_ROOTS)} SELECT n, max(level) AS level FROM lv GROUP BY n")
def toposort_levels(spark, sf_dir):
    return graph.levels(edges(spark, sf_dir))


@query(f"WITH RECURSIVE e AS ({EDGES}), {_LEVELS.format(start=_ROOTS)} SELECT wave, count(*) AS n_ops FROM (SELECT n, max(level) AS wave FROM lv GROUP BY n) GROUP BY wave")
def execution_waves(spark, sf_dir):
    return graph.levels(edges(spark, sf_dir)).groupBy(F.col("level").alias("wave")).agg(F.count(F.lit(1)).alias("n_ops"))


@query(f"SELECT p AS parent, c AS child FROM ({EDGES}) WHERE starts_with(p, 'n:') AND starts_with(c, 'c:') OR starts_with(p, 'r:')")
def subgraph_edges(spark, sf_dir):
    all_edges = edges(spark, sf_dir)
    ends = all_edges.select(F.explode(F.array("parent", "child")).alias("n")).filter(F.substring("n", 1, 2).isin("r:", "n:", "c:"))
    return graph.induced(all_edges, ends)


@query(f"WITH RECURSIVE e AS ({EDGES}), {_UP.format(start=_LINES)}, {_DOWN.format(start=chr(39).join(['SELECT ', 'r:0', '']))} SELECT n FROM a INTERSECT SELECT n FROM d")
def param_subgraph(spark, sf_dir):
    return graph.between(edges(spark, sf_dir), nodes(spark, "r:0"), _lines(spark, sf_dir))


@query(f"WITH RECURSIVE e AS ({EDGES}), {_DOWN.format(start=chr(39).join(['SELECT ', 'c:1', '']))} SELECT n FROM d WHERE NOT starts_with(n, 'o:')")
def reset_descendants(spark, sf_dir):
    """Everything below a customer has to be computed again, but for orders, which are constants here."""
    all_edges = edges(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.concat_ws(":", F.lit("o"), "o_orderkey").alias("n"))
    return graph.reset(all_edges, nodes(spark, "c:1"), orders)


@query("SELECT address, target FROM (SELECT turn, conv_id||':'||turn AS address, conv_id||':'||min(turn) OVER (PARTITION BY conv_id) AS target FROM conversations) WHERE turn > 0")
def resolve_links(spark, sf_dir):
    """Each turn links to the one before it."""
    rows = table(spark, sf_dir, "conversations").filter("turn > 0")
    return graph.resolve_links(rows.select(F.concat_ws(":", "conv_id", "turn").alias("address"), F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("to")))


@query(
    """
SELECT n_regionkey AS region, 'digraph G {'||chr(10)||string_agg('Nr'||n_regionkey||' -> Nn'||n_nationkey||' [label="'||replace(n_name, '"', chr(92)||'"')||'"];', chr(10) ORDER BY n_nationkey)||chr(10)||'}' AS dot
FROM nation GROUP BY n_regionkey
"""
)
def dot_export(spark, sf_dir):
    line = F.concat(F.lit("Nr"), F.col("n_regionkey"), F.lit(" -> Nn"), F.col("n_nationkey"), F.lit(' [label="'), text.dot_label(F.col("n_name")), F.lit('"];'))
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(text.concat_rows(line, F.col("n_nationkey"), "\n").alias("body"))
    return rows.select("region", F.concat(F.lit("digraph G {\n"), F.col("body"), F.lit("\n}")).alias("dot"))


# ------------------------------------------------------------------ status
@query("SELECT l_orderkey, bool_and(l_linestatus = 'F') AS cached FROM lineitem GROUP BY l_orderkey")
def is_cached(spark, sf_dir):
    status = F.when(F.col("l_linestatus") == "F", 1).otherwise(0)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(status > 0).alias("cached"))


@query("SELECT o_custkey, bool_and(o_orderstatus IN ('F', 'P')) AS met, count(*) FILTER (o_orderstatus = 'O') AS waiting FROM orders GROUP BY o_custkey")
def deps_met(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 3).otherwise(0)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and(status > 0).alias("met"), F.count_if(status <= 0).alias("waiting"))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def first_writer(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def last_writer(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


# ------------------------------------------------------------------ parametric plans
def _plans(spark: SparkSession, sf_dir: str) -> Plans:
    def costly(least: float, status: str) -> DataFrame:
        rows = table(spark, sf_dir, "orders").filter((F.col("o_totalprice") > least) & (F.col("o_orderstatus") == status))
        return rows.select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("v"))

    plans = Plans()
    plans.commit("costly", costly, least=1000.0, status="F")
    return plans


@query("SELECT o_orderkey, round(o_totalprice * 2, 2) AS v FROM orders WHERE o_totalprice > 50000 AND o_orderstatus = 'O'")
def param_recall(spark, sf_dir):
    return _plans(spark, sf_dir).recall("costly", least=50000.0, status="O")


@query("SELECT o_orderkey, round(o_totalprice * 2, 2) AS v FROM orders WHERE o_totalprice > 50000 AND o_orderstatus = 'F'")
def param_defaults(spark, sf_dir):
    return _plans(spark, sf_dir).recall("costly", least=50000.0)


@query("SELECT o_orderkey, coalesce(nullif(o_orderpriority, '1-URGENT'), nullif(o_orderstatus, 'O'), 'default') AS v FROM orders")
def options_layering(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.nullif("o_orderpriority", F.lit("1-URGENT")), F.nullif("o_orderstatus", F.lit("O")), F.lit("default")).alias("v"))


# ------------------------------------------------------------------ external programs
def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.upper("n_name").alias("a"), F.lower("n_name").alias("b"))


@query("SELECT n_nationkey, upper(n_name)||lower(n_name) AS v FROM nation")
def shell_cat(spark, sf_dir):
    ran = shell.over_rows(_nations(spark, sf_dir), ["cat file1 file2"], {"file1": "a", "file2": "b"})
    return ran.select("n_nationkey", shell.only("stdouts").cast("string").alias("v"))


@query("SELECT n_nationkey, '0,3' AS codes, lower(n_name) AS v FROM nation")
def shell_returncode(spark, sf_dir):
    ran = shell.over_rows(_nations(spark, sf_dir), ["cp file2 file3", "exit 3"], {"file2": "b"}, ["file3"])
    return ran.select("n_nationkey", F.array_join(F.transform("returncodes", lambda c: c.cast("string")), ",").alias("codes"), F.col("files")["file3"].cast("string").alias("v"))


@query("SELECT n_nationkey, 'MissingOutput' AS err FROM nation")
def shell_missing_output(spark, sf_dir):
    ran = shell.over_rows(_nations(spark, sf_dir), ["cp file1 file2"], {"file1": "a"}, ["file2", "file3"])
    r = results.missing_output(F.try_element_at("files", F.lit("file3")), "shell")
    return ran.select("n_nationkey", r["error"]["kind"].alias("err"))
