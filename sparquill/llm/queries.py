"""Queries of the training-data operators, with their production parameters."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, coordinate_join, exact_dedup, jaccard_groups, matroska, merkle, mixing, packing, pseudonyms, quality, token_counts, token_output, vector_codes
from .common import Workspace, small_batches, table, text_steps

#: The score from which a text stays.
ACCEPT = 0.3
METADATA = ["n_chars"]
PSEUDONYM_KEY = "sparquill-demonstration-key"

LEVELS = ["domain", "lang", "source"]
#: Domains by the last digit of a source's number; sources without one are "other".
WEIGHTS = {"domain": {"web": 4.0, "books": 2.0, "forum": 2.0, "other": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}}
MAX_EPOCHS = 2


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *METADATA)
    model = quality.train(docs, table(spark, sf_dir, "labels"), METADATA)
    got = quality.score(docs, model, METADATA)
    return got.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)
    return got.select("doc_id", "text", F.size("found").cast("long").alias("n_values"), F.array_join(F.array_sort("found"), ",").alias("kinds"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.similar_components(table(spark, sf_dir, "documents"), Workspace(spark, "op4"), words=4, percent=85)


def domain(source) -> F.Column:
    n = F.try_element_at(F.split(source, r"\D+"), F.lit(-1))
    last = F.substring(n, -1, 1)
    return F.when(last.isin("0", "1", "2", "3"), "web").when(last.isin("4", "5", "6"), "books").when(last.isin("7", "8", "9"), "forum").otherwise("other")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of all tokens there are, in the target weights, from at most two epochs of each source.

    Tokens are words here, so that SQL can count them too; the pipeline mixes counts of the vocabulary.
    """
    ws = Workspace(spark, "op5")
    docs = table(spark, sf_dir, "documents")
    sizes = ws.stage(docs.select("doc_id", domain(F.col("source")).alias("domain"), "lang", "source", mixing.words(F.col("text")).alias("n_tokens")), "sizes")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    return mixing.mix(sizes, LEVELS, total, MAX_EPOCHS, WEIGHTS).select("doc_id", *LEVELS, "n_tokens", "copies")


PLANTED = "\\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    log = chat.events_of_rows(rows.unionByName(planted))
    return chat.digests(chat.read_back(chat.render(chat.messages(log))))


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, "text"):
                rows = []
                for t in part.column("text"):
                    raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                    padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
                    media = matroska.mux(padded)
                    movie = matroska.parse(media)
                    if movie.error:
                        raise ValueError(movie.error)
                    packets = matroska.packet_rows(movie)
                    back = matroska.payload(media, packets)
                    _, codec, last_ns, *_ = packets[-1]
                    cued = sum(p[9] for p in packets)
                    feature = f"tracks={len(movie.tracks)};codec={codec};clusters={len(movie.clusters)};packets={len(packets)};cues={len(movie.cues)};cued={cued};last_ns={last_ns};last_bytes={packets[-1][6]};lacing={','.join(sorted({p[8] for p in packets}))};sum={sum(back)}"
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, schema)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"), Workspace(spark, "op8"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are tokens of the byte-level vocabulary."""
    counts = op1_token_counts(spark, sf_dir).select("doc_id", "n_tokens")
    return packing.pack_documents(Workspace(spark, "op9").stage(counts, "sizes"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op10")
    token_output.write_tokens(table(spark, sf_dir, "documents"), ws.path("tokens"), vocabulary("word_bpe_49k.json"))
    return token_output.token_digests(token_output.read_tokens(spark, ws.path("tokens")))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordinate_join.near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "op11"), words=5, percent=85)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # a decimal, as the largest long has a successor, too
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(docs, Workspace(spark, "op12"), ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": more}, changed)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), Workspace(spark, "op13"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_quality, op3_pseudonyms, op4_jaccard_join, op5_mixing, op6_chat, op7_matroska, op8_exact_dedup, op9_packing, op10_token_output, op11_minhash, op12_merkle, op13_vector_codes)}


def _share(inner: str, parent: str, path: str, level: str) -> str:
    """One level of the budget tree in SQL, from a relation with ``above``, ``capacity`` and ``weight``."""
    part = f"PARTITION BY {parent}" if parent else ""
    by = f"ORDER BY {level} NULLS FIRST"
    return f"""SELECT {path}, CAST(filled + CASE WHEN filled < capacity AND SUM(CASE WHEN filled < capacity THEN 1 ELSE 0 END) OVER ({part} {by} ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS BIGINT) AS budget
  FROM (SELECT *, LEAST(above, SUM(capacity) OVER ({part})) - SUM(filled) OVER ({part}) AS rest
    FROM (SELECT *, CASE WHEN weight > 0 AND mark.den > 0 THEN LEAST(CAST(capacity AS HUGEINT), CAST(weight AS HUGEINT) * mark.num // mark.den) ELSE 0 END AS filled
      FROM (SELECT *, arg_max({{'num': num, 'den': den}}, CASE WHEN den > 0 THEN CAST(num AS DOUBLE) / CAST(den AS DOUBLE) END) OVER ({part}) AS mark
        FROM (SELECT *, GREATEST(0, above - COALESCE(SUM(capacity) OVER ({part} ORDER BY ratio, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS num,
            SUM(weight) OVER ({part} ORDER BY ratio, {level} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den
          FROM (SELECT *, CASE WHEN weight > 0 THEN CAST(capacity AS DOUBLE) / weight ELSE CAST('inf' AS DOUBLE) END AS ratio FROM ({inner}) x) y) z) u) v) t"""


def mixing_sql(weights: dict[str, dict[str, float]] = WEIGHTS, epochs: int = MAX_EPOCHS, total: str = "(SELECT SUM(n_tokens) FROM sizes)") -> str:
    def weight(level: str, column: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {int(v * mixing.UNIT)}" for k, v in weights.get(level, {}).items())
        return f"CAST(CASE {column} {cases} ELSE {mixing.UNIT} END AS BIGINT)" if cases else f"CAST({mixing.UNIT} AS BIGINT)"

    n = "regexp_extract(source, '([0-9]*)[^0-9]*$', 1)"
    l1 = _share(f"SELECT domain, SUM(capacity) AS capacity, {total} AS above, {weight('domain', 'domain')} AS weight FROM leaves GROUP BY domain", "", "domain", "domain")
    l2 = _share(f"SELECT l.domain, l.lang, b.budget AS above, SUM(capacity) AS capacity, {weight('lang', 'l.lang')} AS weight FROM leaves l JOIN b1 b ON l.domain IS NOT DISTINCT FROM b.domain GROUP BY l.domain, l.lang, b.budget", "domain", "domain, lang", "lang")
    l3 = _share(f"SELECT l.domain, l.lang, l.source, b.budget AS above, capacity, {weight('source', 'l.source')} AS weight FROM leaves l JOIN b2 b ON l.domain IS NOT DISTINCT FROM b.domain AND l.lang IS NOT DISTINCT FROM b.lang", "domain, lang", "domain, lang, source", "source")
    positive = " AND ".join(f"{weight(c, c)} > 0" for c in LEVELS)
    return f"""WITH sizes AS (
  SELECT doc_id, CASE WHEN right({n}, 1) IN ('0','1','2','3') THEN 'web' WHEN right({n}, 1) IN ('4','5','6') THEN 'books' WHEN right({n}, 1) IN ('7','8','9') THEN 'forum' ELSE 'other' END AS domain,
    lang, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(SUM(n_tokens) AS BIGINT) AS tokens, CAST(CASE WHEN {positive} THEN SUM(n_tokens) * {epochs} ELSE 0 END AS BIGINT) AS capacity FROM sizes GROUP BY domain, lang, source),
b1 AS ({l1}), b2 AS ({l2}), b3 AS ({l3}),
plan AS (SELECT b3.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS full_epochs, tokens FROM b3 JOIN leaves l ON b3.domain IS NOT DISTINCT FROM l.domain AND b3.lang IS NOT DISTINCT FROM l.lang AND b3.source IS NOT DISTINCT FROM l.source),
placed AS (SELECT s.*, full_epochs, budget - full_epochs * tokens AS rest,
    COALESCE(SUM(n_tokens) OVER (PARTITION BY s.domain, s.lang, s.source ORDER BY md5('mix:' || full_epochs || ':' || COALESCE(CAST(doc_id AS VARCHAR), 'null')), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN plan p ON s.domain IS NOT DISTINCT FROM p.domain AND s.lang IS NOT DISTINCT FROM p.lang AND s.source IS NOT DISTINCT FROM p.source)
SELECT * FROM (SELECT doc_id, domain, lang, source, n_tokens, CAST(full_epochs + CASE WHEN rest > 0 AND 2 * (rest - before) >= n_tokens THEN 1 ELSE 0 END AS BIGINT) AS copies FROM placed) WHERE copies > 0"""


def merkle_sql() -> str:
    """All levels of all trees by recursion, a row for each node; then each leaf climbs with its siblings."""
    part = lambda c: f"COALESCE(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda chars: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", chars, "text")) + ")"
    bit = "list_reduce(list_concat([xor(c, CAST(b AS BIGINT))], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: {bit}), 4294967295)"
    above = lambda t, key: f"SELECT {key}h + 1 AS h, p // 2 AS p, (n + 1) // 2 AS n, sha256(string_agg(d, '' ORDER BY p)) AS d FROM {t} WHERE n > 1 GROUP BY {key}h, p // 2, n"
    return f"""WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, COUNT(*) OVER (PARTITION BY lang) AS total
  FROM (SELECT doc_id, lang, {leaf('n_chars')} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {leaf('CAST(n_chars AS HUGEINT) + 1')} END AS bad FROM documents) x),
trees AS (SELECT lang, 0 AS h, place AS p, total AS n, leaf AS d FROM leaves
  UNION ALL ({above('trees', 'lang, ')})),
subroots AS MATERIALIZED (SELECT lang, d, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place, COUNT(*) OVER () AS total FROM trees WHERE n = 1),
tops AS (SELECT 0 AS h, place AS p, total AS n, d FROM subroots UNION ALL ({above('tops', '')})),
base AS MATERIALIZED (SELECT s.lang, s.d AS subroot, s.place, l.h FROM subroots s JOIN trees l ON l.n = 1 AND s.lang IS NOT DISTINCT FROM l.lang),
others AS MATERIALIZED (SELECT lang, h, p, n, d FROM trees UNION ALL SELECT b.lang, t.h + b.h, t.p, t.n, t.d FROM tops t, base b),
climb AS (SELECT v.doc_id, v.lang, v.leaf, b.subroot, v.place AS own, 0 AS h, b.h AS turn, b.place AS next, COALESCE(v.bad, v.leaf) AS d, '' AS proof, v.total AS n, v.place AS p, t.total AS tops
  FROM leaves v JOIN base b ON v.lang IS NOT DISTINCT FROM b.lang, (SELECT COUNT(*) AS total FROM subroots) t
  UNION ALL
  SELECT c.doc_id, c.lang, c.leaf, c.subroot, c.own, c.h + 1, c.turn, c.next,
    CASE WHEN o.d IS NULL THEN sha256(c.d) WHEN c.p % 2 = 1 THEN sha256(o.d || c.d) ELSE sha256(c.d || o.d) END, c.proof || COALESCE(o.d, ''), (c.n + 1) // 2, c.p // 2, c.tops
  FROM (SELECT * REPLACE (CASE WHEN h = turn THEN next ELSE p END AS p, CASE WHEN h = turn THEN tops ELSE n END AS n) FROM climb) c
  LEFT JOIN others o ON o.lang IS NOT DISTINCT FROM c.lang AND o.h = c.h AND o.n = c.n AND o.p = xor(c.p, 1)
  WHERE c.n > 1),
root AS (SELECT d FROM tops WHERE n = 1),
last AS (SELECT *, row_number() OVER (PARTITION BY lang, own ORDER BY h DESC) AS k FROM climb)
SELECT doc_id, leaf, subroot, root.d AS root, sha256(proof) AS proof_sha256, last.d AS folded_root, last.d = root.d AS verified FROM last, root WHERE k = 1"""


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every distance of every round, in whole numbers."""
    out = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS q, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS k
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (SELECT k, CAST((i - 1) // (n // {parts}) AS INTEGER) AS part, (i - 1) % (n // {parts}) AS pos, v FROM (SELECT k, len(q) AS n, unnest(q) AS v, generate_subscripts(q, 1) AS i FROM kept) x),
book0 AS MATERIALIZED (SELECT part, CAST(k - 1 AS INTEGER) AS entry, pos, v AS c FROM cells WHERE k <= {entries})"""
    for r in range(rounds + 1):
        out += f""",
near{r} AS MATERIALIZED (SELECT k, part, min(d) AS d, CAST(arg_min(entry, d * {entries} + entry) AS INTEGER) AS entry
  FROM (SELECT k, part, entry, CAST(SUM((v - c) * (v - c)) AS BIGINT) AS d FROM cells JOIN book{r} USING (part, pos) GROUP BY k, part, entry) x GROUP BY k, part)"""
        if r < rounds:
            out += f""",
book{r + 1} AS MATERIALIZED (SELECT part, entry, pos, CAST(COALESCE(m, c) AS BIGINT) AS c FROM book{r} LEFT JOIN
  (SELECT part, entry, pos, (SUM(v) - (SUM(v) % COUNT(*) + COUNT(*)) % COUNT(*)) // COUNT(*) AS m FROM cells JOIN near{r} USING (k, part) GROUP BY part, entry, pos) x USING (part, entry, pos))"""
    return out + f""",
coded AS (SELECT k, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(SUM(d) AS BIGINT) AS error FROM near{rounds} GROUP BY k)
SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(c, ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (k)"""


def oracle_sql() -> dict[str, str]:
    norm = "regexp_replace(COALESCE(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')"
    escaped = "replace(replace(replace({0}, '\\', '\\\\'), '#', '\\#'), '</turn>', '<\\/turn>')"
    order = "ORDER BY turn, role, text"
    return {
        "op5_mixing": mixing_sql(),
        "op6_chat": f"""WITH rows_ AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}')
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(COALESCE(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(SUM(15 + length(replace(replace({escaped.format('role')}, chr(10), '\\n'), ':', '\\c')) + length({escaped.format('text')})) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id""",
        "op12_merkle": merkle_sql(),
        "op13_vector_codes": codes_sql(),
        "op8_exact_dedup": f"""WITH d AS (SELECT doc_id, sha256({norm}) AS text_sha256 FROM documents)
SELECT doc_id, MIN(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, COUNT(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = MIN(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM d""",
    }
