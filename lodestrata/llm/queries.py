"""The queries of this subpackage, ``opN_<name>``, and the SQL for those that SQL can express.

Each query is thin: it applies its operator to the whole table with production parameters and derives the
columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import chat, divergence, exact_topk, merkle, one_bit_codes, packing, pieces, quality, simhash, speculative, token_counts, toxicity, url_filter
from lodestrata.storage import materialise

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The production list, made by a rule: each kind of site under each of these domains as a whole, its numbered mirrors, and
#: numbered pages of one host. No entry is picked from a table.
KINDS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
DOMAINS = ("example.com", "example.net", "example.org")
MIRRORS, LISTED_PAGES = 1000, 20_000


def listed_urls(spark: SparkSession) -> DataFrame:
    """The production list: some 38,000 canonical URLs."""
    kinds = spark.createDataFrame([(k, d) for k in KINDS for d in DOMAINS], "kind string, domain string")
    sites = kinds.select(F.concat("kind", F.lit("."), "domain", F.lit("/")).alias("url"))
    mirrors = kinds.select("*", F.explode(F.sequence(F.lit(1), F.lit(MIRRORS))).alias("n")).select(F.concat("kind", F.lit("-"), F.col("n").cast("string"), F.lit("."), "domain", F.lit("/")).alias("url"))
    pages = spark.range(1, LISTED_PAGES + 1).select(F.concat(F.lit("mirror.example.org/listed/"), F.col("id").cast("string")).alias("url"))
    return sites.unionByName(mirrors).unionByName(pages)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where the public tokenizer file is; every executor has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(turns.unionByName(planted)))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), listed_urls(spark), RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = materialise(one_bit_codes.build_index(_table(spark, sf_dir, "embeddings")), "codes")
    return one_bit_codes.search(index, index.where("id % 20 = 0"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest_documents(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("int"))


def op12_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speculative.digest_documents(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_format, op2_url_filter, op3_quality, op4_token_counts, op5_best_fit_packing, op6_simhash, op7_exact_topk, op8_one_bit_codes, op9_sentencepiece, op10_toxicity, op11_divergence_audit, op12_speculative_bpe, op13_merkle_manifest)}

_CONTROLS = ", ".join(f"'{c}'" for c in chat.CONTROLS)
_ESCAPED = lambda x: f"length({x}) + length({x}) - length(replace({x}, '{chat.ESCAPE}', '')) + 2 * list_sum(list_transform([{_CONTROLS}], lambda c: (length({x}) - length(replace({x}, c, ''))) // length(c)))"
_HOST = r"translate(regexp_extract(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = ", ".join(f"('{r}', '{v}')" for r, v in RULES)
_FRAMED = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
_LEAF = lambda more: f"sha256({_FRAMED('doc_id')} || {_FRAMED('source')} || {_FRAMED('lang')} || {_FRAMED(f'(n_chars + {more})')} || {_FRAMED('text')})"
#: The checksum's register goes through the bytes of the decimal id, bit by bit.
_BITS = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, (r & 1) * 3988292384))"
_CRC32 = f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: {_BITS}))"
_VALUES = lambda values: ", ".join(f"('{x}')" for x in values)

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST({len(chat.OPEN + chat.CLOSE)} + sum({_ESCAPED("role")} + {_ESCAPED("text")} + {len(chat.TURN + chat.END) + 1}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op2_url_filter": f"""
WITH kinds AS (SELECT * FROM (VALUES {_VALUES(KINDS)}) AS k(kind), (VALUES {_VALUES(DOMAINS)}) AS d(domain)),
listed AS (
  SELECT kind || '.' || domain || '/' AS entry FROM kinds
  UNION ALL SELECT kind || '-' || n || '.' || domain || '/' FROM kinds, range(1, {MIRRORS + 1}) AS r(n)
  UNION ALL SELECT 'mirror.example.org/listed/' || n FROM range(1, {LISTED_PAGES + 1}) AS r(n)),
split AS (
  SELECT page_id, coalesce({_HOST}, '') AS host,
    coalesce(regexp_extract(regexp_replace(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^/?#]*', ''), '^[^?#]*'), '') AS path
  FROM pages),
canonical AS (
  SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m|blog)\\.', '') AS site,
    regexp_replace(regexp_replace(path, '/index\\.html?$', ''), '/+$', '') AS tail FROM split),
judged AS (
  SELECT *, (SELECT max_by({{'rule': r, 'verdict': v}}, length(r)) FROM (VALUES {_RULES}) AS rules(r, v)
    WHERE (host = split_part(r, '/', 1) OR ends_with(host, '.' || split_part(r, '/', 1))) AND starts_with(path, substr(r, strpos(r, '/')))) AS best FROM canonical)
SELECT page_id, host, path, best.rule AS rule, CASE WHEN best IS NOT NULL THEN best.verdict
  WHEN host <> '' AND (site || '/' IN (FROM listed) OR site || CASE WHEN tail = '' THEN '/' ELSE tail END IN (FROM listed)) THEN 'block' ELSE 'allow' END AS verdict
FROM judged""",
    "op7_exact_topk": """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20""",
    "op11_divergence_audit": r"""
WITH read AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
sources AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
kept AS (SELECT lang, term, count(*) AS n FROM read GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM sources) LEFT JOIN kept USING (lang) GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS n FROM read SEMI JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY s.lang, s.source) AS total
  FROM sources s JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
shares AS (
  SELECT d.lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // CAST(d.total + 5 * v AS HUGEINT) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (lang_n + 5) // CAST(l.total + 5 * v AS HUGEINT) AS q
  FROM dense d JOIN langs l USING (lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_LEAF(0)} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC32} % 7 = 0 THEN {_LEAF(1)} ELSE {_LEAF(0)} END AS start
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS nodes FROM leaves),
level AS (
  SELECT tree, 0 AS step, place, nodes, leaf AS h FROM placed
  UNION ALL SELECT tree, step + 1, place // 2, (nodes + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM level WHERE nodes > 1 GROUP BY tree, step, place // 2, nodes),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS nodes FROM level WHERE nodes = 1),
top AS (
  SELECT 0 AS step, place, nodes, h FROM subroots
  UNION ALL SELECT step + 1, place // 2, (nodes + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM top WHERE nodes > 1 GROUP BY step, place // 2, nodes),
steps AS (SELECT DISTINCT tree, step FROM level WHERE nodes > 1),
top_steps AS (SELECT DISTINCT step FROM top WHERE nodes > 1),
siblings AS (
  SELECT p.tree, p.place, t.step, CASE WHEN s.place < p.place >> t.step THEN 'l' ELSE 'r' END || s.h AS side
  FROM placed p JOIN steps t ON t.tree = p.tree LEFT JOIN level s ON s.tree = p.tree AND s.step = t.step AND s.place = xor(p.place >> t.step, 1)
  UNION ALL SELECT p.tree, p.place, 1000 + t.step, CASE WHEN s.place < r.place >> t.step THEN 'l' ELSE 'r' END || s.h
  FROM placed p JOIN subroots r ON r.tree = p.tree, top_steps t LEFT JOIN top s ON s.step = t.step AND s.place = xor(r.place >> t.step, 1)),
paths AS (SELECT tree, place, list(coalesce(side, '') ORDER BY step) AS path FROM siblings GROUP BY tree, place),
folded AS (
  SELECT p.doc_id, p.leaf, r.h AS subroot, (SELECT h FROM top WHERE nodes = 1) AS root, sha256(array_to_string(list_transform(coalesce(path, []), lambda x: substr(x, 2)), '')) AS proof_sha256,
    list_reduce(list_concat([p.start], coalesce(path, [])), lambda h, x: sha256(CASE substr(x, 1, 1) WHEN 'l' THEN substr(x, 2) || h WHEN 'r' THEN h || substr(x, 2) ELSE h END)) AS folded_root
  FROM placed p JOIN subroots r ON r.tree = p.tree LEFT JOIN paths ON paths.tree = p.tree AND paths.place = p.place)
SELECT *, folded_root = root AS verified FROM folded""",
}
