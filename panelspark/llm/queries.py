"""One query for each operator of this package, applied to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bpe_count, chosen_path, class_lm, conversation_repair, cross_parse, cuckoo_dedup, decontam, resharding, secrets_zstd, suffix_dedup, url_trie, vector_codes
from ..session import cut_lineage
from .common import documents, held_out

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The rules that the pages are judged by.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Tokens from which a document is over the limit of a context window.
TOKEN_LIMIT = 1024
#: Documents lie in shards by source, of which the last ones are given up.
OLD_SHARDS, NEW_SHARDS = 10, 8


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path, split_pattern(), offsets=False).drop("text")
    return bpe.decode(encoded.withColumn("n_tokens", F.size("ids").cast("bigint")), path, drop_ids=True).select(
        "doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (~held_out(F.col("doc_id"), 7, 2)).alias("training"))
    return class_lm.score(docs).select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo_dedup.exact_groups(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


_BLANK = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
SQL["op3_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_BLANK}, '')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents),
g AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_trie.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


# as in the trie, a rule with more host labels is longer, then one with a longer path
_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}', {100_000 * (h.count('.') + 1) + len(p)})" for v, h, p in URL_RULES)
SQL["op4_url_filter"] = f"""
WITH rules(verdict, rhost, rpath, size) AS (VALUES {_RULES_SQL}),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
best AS (SELECT page_id, arg_max(rhost || rpath, size) AS rule, arg_max(rules.verdict, size) AS verdict FROM p JOIN rules
 ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best ON p.page_id = best.page_id
"""


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labelled = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"), 5, 0))
    judged = cross_parse.identify(docs.select("doc_id", "text"), labelled)
    return judged.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


@query
def op6_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    scanned = decontam.scan(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return scanned.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = bpe_count.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), TOKEN_LIMIT)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets_zstd.scan(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"))


@query
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chosen_path.near_groups(documents(spark, sf_dir).select("doc_id", "text"), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    coded, books = vector_codes.compress(vectors, "embedding", [F.col("vec_id")])
    summed = vector_codes.with_group_error(cut_lineage(coded.select("vec_id", "label", "code", "error")), "label")
    return summed.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256"))


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    found = [
        f"""e AS MATERIALIZED (SELECT vec_id, label, v, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS id, len(v) // {parts} AS width FROM
 (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
        f"x AS MATERIALIZED (SELECT id, p AS part, i AS pos, v[p * width + i + 1] AS x FROM e, range({parts}) a(p), range(width) b(i))",
        f"c0 AS MATERIALIZED (SELECT part, id - 1 AS entry, pos, x AS c FROM x WHERE id <= {entries})",
    ]
    for r in range(rounds + 1):
        found.append(f"d{r} AS (SELECT id, x.part, entry, sum((x - c) * (x - c)) AS d FROM x JOIN c{r} ON x.part = c{r}.part AND x.pos = c{r}.pos GROUP BY id, x.part, entry)")
        found.append(f"a{r} AS MATERIALIZED (SELECT id, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM d{r} GROUP BY id, part)")
        if r < rounds:
            found.append(f"m{r} AS (SELECT x.part, entry, pos, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS c FROM x JOIN a{r} ON x.id = a{r}.id AND x.part = a{r}.part GROUP BY x.part, entry, pos)")
            found.append(f"c{r + 1} AS MATERIALIZED (SELECT o.part, o.entry, o.pos, coalesce(m.c, o.c)::BIGINT AS c FROM c{r} o LEFT JOIN m{r} m ON m.part = o.part AND m.entry = o.entry AND m.pos = o.pos)")
    found.append(f"coded AS (SELECT id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id)")
    found.append(f"digest AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds})")
    return f"WITH {', '.join(found)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN coded ON e.id = coded.id, digest"


SQL["op11_vector_codes"] = _codes_sql()


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversation_repair.repairs(conversation_repair.damaged(turns)).withColumnRenamed("conv", "conv_id")


@query
def op13_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    old = F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % OLD_SHARDS
    docs = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), old.alias("by_source"))
    placed = resharding.reshard(docs, F.col("by_source"), F.col("size"), [1] * NEW_SHARDS, [F.col("doc_id"), F.col("text_crc32")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, four bits at a time."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    step = lambda c, b: f"xor(({table}::BIGINT[])[(xor({c}, {b}) & 15) + 1], {c} >> 4)"
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: {step(step('c', 'b'), '(b >> 4)')}), 4294967295)"


SQL["op13_resharding"] = f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {_crc32_sql("coalesce(text, '')")} AS text_crc32, {_crc32_sql("coalesce(source, '')")} % {OLD_SHARDS} AS old_shard FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY old_shard ORDER BY size, doc_id NULLS FIRST, text_crc32) - 1 AS rank FROM d),
s AS (SELECT i AS shard, n // {NEW_SHARDS} AS q, n % {NEW_SHARDS} AS extra, (SELECT count(*) FROM d WHERE old_shard = i) AS have FROM range({NEW_SHARDS}) t(i), (SELECT count(*) AS n FROM d)),
m AS (SELECT s.*, r.size AS price FROM s LEFT JOIN r ON r.old_shard = shard AND rank = have - q - 1),
u AS (SELECT *, q + (row_number() OVER (ORDER BY price DESC NULLS LAST, shard) <= extra)::INT AS room FROM m),
need AS (SELECT shard, sum(greatest(room - have, 0)) OVER (ORDER BY shard) AS stop, stop - greatest(room - have, 0) AS start FROM u),
gone AS (SELECT r.*, row_number() OVER (ORDER BY old_shard, rank) - 1 AS pos FROM r JOIN (SELECT old_shard AS o, count(*) AS n FROM d GROUP BY 1) ON old_shard = o LEFT JOIN u ON shard = old_shard WHERE rank < n - coalesce(room, 0)),
placed AS (SELECT r.*, coalesce(need.shard, r.old_shard) AS shard FROM r LEFT JOIN gone ON gone.old_shard = r.old_shard AND gone.rank = r.rank LEFT JOIN need ON pos >= start AND pos < stop)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY old_shard, rank) - 1 AS slot, NULL::INT AS grown_shard, old_shard FROM placed
"""


def _repair_sql() -> str:
    plus = lambda way, cost, edit: f"CASE WHEN {way} IS NOT NULL THEN {{'c': {way}.c + {cost}, 'a': {way}.a || {edit}}} END"
    best = lambda *ways: f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"
    turned = lambda role, *ways: best(*(plus(w, f"CASE WHEN i = '{role}' THEN 0 ELSE 1 END + extra", f"CASE WHEN i = '{role}' THEN 'K' ELSE 'R' END") for w in ways))
    stays = "fault NOT IN ('blank', 'duplicate')"
    blank = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
    return f"""
WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
 {_crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
after AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
 unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM base WHERE k <> 0),
sorted AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS idx FROM after),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, left(role, 1) AS i, idx,
 CASE WHEN rtrim(text, {blank}) = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY idx) > 1 THEN 'duplicate'
 WHEN right(rtrim(text, {blank}), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM sorted),
walk AS (SELECT DISTINCT conv_id, 0::BIGINT AS idx, {{'c': 0::BIGINT, 'a': ''}} AS s, NULL::STRUCT(c BIGINT, a VARCHAR) AS y, NULL::STRUCT(c BIGINT, a VARCHAR) AS u, NULL::STRUCT(c BIGINT, a VARCHAR) AS a FROM base
 UNION ALL
 SELECT w.conv_id, f.idx, {plus("w.s", 2, "'D'")},
  {best(plus("w.y", 2, "'D'"), f"CASE WHEN {stays} AND i = 's' THEN {plus('w.s', 'extra', chr(39) + 'K' + chr(39))} END")},
  {best(plus("w.u", 2, "'D'"), f"CASE WHEN {stays} THEN {turned('u', 'w.s', 'w.y', 'w.a')} END")},
  {best(plus("w.a", 2, "'D'"), f"CASE WHEN {stays} THEN {turned('a', 'w.u')} END")}
 FROM (SELECT conv_id, idx, s, y, {best("u", plus("s", 5, "'I'"), plus("y", 5, "'I'"), plus("a", 5, "'I'"))} AS u, {best("a", plus("u", 5, "'I'"), plus("s", 10, "'II'"), plus("y", 10, "'II'"))} AS a FROM walk) w
 JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.idx = w.idx + 1),
done AS (SELECT conv_id, {best("s", "a", plus("u", 5, "'I'"), plus("y", 10, "'II'"))} AS way FROM walk QUALIFY idx = max(idx) OVER (PARTITION BY conv_id)),
letters AS (SELECT conv_id, k, substr(way.a, k, 1) AS edit, sum((substr(way.a, k, 1) <> 'I')::INT) OVER w AS idx, sum((substr(way.a, k, 1) <> 'D')::INT) OVER w AS place
 FROM (SELECT conv_id, way, unnest(range(1, length(way.a) + 1)) AS k FROM done) WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
told AS (SELECT l.*, f.i, f.role, f.text, max(CASE WHEN place = 1 AND edit = 'K' AND f.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS off
 FROM letters l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.idx = l.idx),
said AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - off) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS all_ FROM told WHERE edit <> 'D' GROUP BY conv_id),
pairs AS (SELECT conv_id, turn, fault, lag(i) OVER (PARTITION BY conv_id ORDER BY idx) || i AS pair FROM f),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 way.c AS cost, way.a AS audit, sha256(coalesce(all_, '')) AS repaired_sha256
FROM done d LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM d.conv_id
"""


SQL["op12_conversation_repair"] = _repair_sql()
