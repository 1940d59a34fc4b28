"""Queries of the training-data operators and their DuckDB equivalents, where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import chat, exact_dedup, exponion, fingerprint, html_text, merkle, mixing, near_dedup, packing, suffix, token_spans, toxicity, warc
from attesta.llm.common import fresh_path, materialize, read


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file; a parameter of the operators, never part of the repository."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages"))


#: Conversation -7 of op2.
CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(f"SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM VALUES {', '.join(map(str, CONTROL_CONVERSATION))} AS t(conv_id, turn, role, text)")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.conversation_digests(chat.chat_windows(turns))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit_on(docs, read(spark, sf_dir, "labels"))
    held = (F.crc32(F.col("doc_id").cast("string")) % 5 == toxicity.HELD_OUT).alias("held_out")
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_tokens", "spans")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents; documents whose id is divisible by 20 are also searched for.

    near_docs counts the documents within the radius of such a document's
    fingerprint, itself included, and is null for the others.
    """
    marked, _ = materialize(fingerprint.document_fingerprints(read(spark, sf_dir, "documents")), "fingerprints")
    classes = marked.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    found = fingerprint.find_near(marked.where(asked), classes)
    near = found.join(classes, found["match"] == classes["fingerprint"]).groupBy("query").agg(F.sum("n").alias("near_docs"))
    counted = marked.where(asked).join(near, F.col("fingerprint") == F.col("query"), "left").drop("query")
    # only what was searched for is shuffled for its count
    return counted.unionByName(marked.where(~asked).withColumn("near_docs", F.lit(None).cast("long")))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.simhash_components(read(spark, sf_dir, "documents"), words=4, radius=4)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"), keep="largest")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    return packing.pack(read(spark, sf_dir, "documents"), lambda: packing.word_tokenizer(path))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    ordered = mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return ordered.withColumn("position", F.round("position", 6))  # rounded for the output only


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    records, _ = materialize(warc.read_archives(spark, path, payloads=False), "warc-records")
    return warc.resolved(records)


def op10_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    pattern = importlib.import_module("public_tokenizers").PATTERN
    return token_spans.section_tokens(read(spark, sf_dir, "documents"), lambda: token_spans.ByteTokenizer(path, pattern))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read(spark, sf_dir, "documents"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.clusters(read(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, salt="1")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = F.regexp_replace("text", "\n", "")
    now = merkle.leaf_digest([text if f == "text" else F.col(f) for f in merkle.FIELDS])
    touched = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.manifest(docs, tampered=F.when(touched, now))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_text, op2_chat_format, op3_toxicity, op4_fingerprint, op5_simhash_dedup, op6_exact_dedup, op7_packing, op8_mixing, op9_warc_revisits, op10_token_spans, op11_suffix_dedup, op12_clusters, op13_merkle_manifest, pipeline)
}

#: Code points that escaping adds to a text or role x.
_ADDED = """(length({x}) - length(replace({x}, chr(92), '')) + (length({x}) - length(replace({x}, '</s>', ''))) // 4 + (length({x}) - length(replace({x}, '<s>', ''))) // 3
  + (length({x}) - length(replace({x}, '<<SYS>>', ''))) // 7 + (length({x}) - length(replace({x}, '<</SYS>>', ''))) // 8
  + (length({x}) - length(replace({x}, '[INST]', ''))) // 6 + (length({x}) - length(replace({x}, '[/INST]', ''))) // 7)"""

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": f"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (SELECT *, ((strlen(text) + 3) // 4 + {chat.TURN_OVERHEAD})::BIGINT AS tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM t),
q AS (SELECT *, sum(tok) OVER w - tok AS start_,
  length('{chat.OPEN}{chat.CLOSE}{chat.END}') + length(role) + length(text) + {_ADDED.format(x="role")} + {_ADDED.format(x="text")} AS len
  FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
f AS (SELECT * FROM q WHERE role = 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos) = 1),
r AS (SELECT q.*, {chat.BUDGET} - CASE WHEN f.pos < q.pos THEN f.tok ELSE 0 END AS room FROM q LEFT JOIN f USING (conv_id)),
x AS (SELECT r.conv_id, r.pos, r.room, min(j.pos) AS context, min(j.start_) AS from_ FROM r JOIN q j ON j.conv_id = r.conv_id AND (j.pos = r.pos OR j.pos < r.pos AND j.pos >= r.pos - {chat.HISTORY} AND (
  r.start_ - j.start_ <= least({chat.HISTORY}, r.room - r.tok) OR (r.role = '{chat.TARGET_ROLE}' AND j.pos = r.pos - 1 AND j.tok <= r.room - r.tok))) GROUP BY ALL),
e AS (SELECT x.*, coalesce((SELECT min(j.pos) FROM q j WHERE j.conv_id = x.conv_id AND j.pos > x.pos AND (j.start_ + j.tok > x.from_ + greatest(x.room, {chat.BUDGET // chat.LEAST_SHARE}) OR j.pos % {chat.SEGMENT} = 0)),
  (SELECT max(j.pos) + 1 FROM q j WHERE j.conv_id = x.conv_id)) AS end_ FROM x),
s AS (SELECT conv_id, pos, context, end_ FROM e WHERE pos = 0 UNION ALL SELECT e.conv_id, e.pos, e.context, e.end_ FROM s JOIN e ON e.conv_id = s.conv_id AND e.pos = s.end_),
own AS (SELECT s.conv_id, sum(q.len) AS chars FROM s JOIN q ON q.conv_id = s.conv_id AND q.pos >= s.context AND q.pos < s.end_ LEFT JOIN f ON f.conv_id = s.conv_id
  WHERE q.pos >= s.pos OR q.pos IS DISTINCT FROM f.pos GROUP BY s.conv_id),
sys AS (SELECT conv_id, sum(f.len) AS chars FROM s JOIN f USING (conv_id) WHERE s.pos > f.pos GROUP BY conv_id),
c AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss FROM q GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (own.chars + coalesce(sys.chars, 0))::BIGINT AS formatted_chars,
  (SELECT count(*) FROM s WHERE s.conv_id = c.conv_id) AS n_windows
FROM c JOIN own USING (conv_id) LEFT JOIN sys USING (conv_id)""",
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat(coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][rank % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS lim FROM s),
v AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(w) OVER (ORDER BY lim / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, rank, source_size, least(lim, (SELECT max(level) FROM v WHERE level <= lim / w) * w) AS target FROM v),
p AS (SELECT d.*, t.rank, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS aim,
  sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN source_size > 0 THEN aim // source_size ELSE 0 END AS full_ FROM p),
o AS (SELECT *, greatest(0, least(size, aim - full_ * source_size - before))::BIGINT AS over_ FROM f),
r AS (SELECT *, full_ * size + over_ AS taken, over_ = size AND size > 0 AS whole FROM o),
y AS (SELECT *, CASE WHEN target > 0 THEN (before + least(size, taken) / 2.0) / target END::DOUBLE AS y,
  CASE rank % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS w0, CASE rank % 3 WHEN 0 THEN -1.0 WHEN 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS slope FROM r)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, (full_ + whole::INT)::BIGINT AS passes, CASE WHEN whole THEN 0 ELSE over_ END::BIGINT AS last_words,
  CASE WHEN taken > 0 THEN round(greatest(0.0, least(1.0, 2.0 * y / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * y, 0.0))))), 6) END::DOUBLE AS position
FROM y""",
    "op9_warc_revisits": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM m""",
    "op11_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT *, octet_length(b) AS n FROM d),
w AS (SELECT r, doc_id, i, b[i + 1:i + 50] AS s FROM (SELECT *, unnest(range(n - 49)) AS i FROM n WHERE n >= 50)),
g AS (SELECT r, i FROM (SELECT r, i, coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY s) AS gone FROM w) WHERE gone),
e AS (SELECT *, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 50, -1) AS new FROM g),
k AS (SELECT *, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM e),
s AS (SELECT r, run, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY r, run),
c AS (SELECT r, a, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM (SELECT r, a, z FROM s UNION ALL SELECT r, n, n FROM n)),
t AS (SELECT r, string_agg(hex(b[p + 1:a]), '' ORDER BY p, a) AS kept FROM c JOIN n USING (r) WHERE a > p GROUP BY r),
m AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM n LEFT JOIN m USING (r) LEFT JOIN t USING (r)""",
}


def _cluster_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, salt: str = "1") -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, unnest(arg_min(struct_pack(cluster := c, distance := d), (d, c))) FROM (SELECT r, vec_id, x, c, list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r}) GROUP BY r, vec_id, x)")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT cluster, list(m ORDER BY i) AS y FROM (SELECT cluster, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY cluster, i) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(s{r}.y, c{r}.y)::BIGINT[] AS y FROM c{r} LEFT JOIN s{r} ON c = cluster)""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS y FROM (SELECT sha256('{salt}:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {k})),
{", ".join(steps)}
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(y, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c = cluster"""


def _merkle_sql(levels: int = 16) -> str:
    """Both kinds of tree, `levels` deep: enough for 3 ** levels leaves in a source."""

    def leaf(text: str) -> str:
        return "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"

    def tree(t: str, key: str) -> str:
        """Levels of the trees of t(key, pos, h): (key, pos, h) as {t}0, {t}1, …; paths as {t}p(key, pos, l, left_, right_)."""
        out = [f"{t}0 AS (SELECT {key}, pos, h, count(*) OVER (PARTITION BY {key}) AS n FROM {t})"]
        for l in range(levels):
            out.append(f"{t}{l + 1} AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM (SELECT {key}, pos // 3 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {t}{l} WHERE n > 1 GROUP BY ALL))")
        tops = " UNION ALL ".join(f"SELECT {key}, h FROM {t}{l} WHERE n = 1" for l in range(levels + 1))
        # a row of each level that has more than one node: the nodes of each run
        runs = " UNION ALL ".join(f"SELECT {key}, {l} AS l, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM {t}{l} WHERE n > 1 GROUP BY ALL" for l in range(levels))
        return ",\n".join([*out, f"{t}top AS ({tops})", f"{t}runs AS MATERIALIZED ({runs})"])

    def climb(t: str, key: str, first: str) -> str:
        """Fold of every leaf of t from `first`: {t}f(key, pos, proof, folded)."""
        return f"""{t}f AS (WITH RECURSIVE f AS (SELECT {key}, pos AS leaf, pos, 0 AS l, '' AS proof, {first} AS h FROM {t}
  UNION ALL SELECT f.{key}, leaf, pos // 3, f.l + 1, proof || array_to_string(hs[:pos % 3] || hs[pos % 3 + 2:], ''), sha256(array_to_string(hs[:pos % 3], '') || h || array_to_string(hs[pos % 3 + 2:], ''))
  FROM f JOIN {t}runs r ON r.{key} = f.{key} AND r.l = f.l AND r.run = f.pos // 3)
  SELECT {key}, leaf AS pos, arg_max(proof, l) AS proof, arg_max(h, l) AS h FROM f GROUP BY ALL)"""

    # CRC-32 bit by bit, over the bytes of a decimal number
    step = "lambda a, z: xor(a >> 1, 3988292384 * (a & 1))"
    crc = f"xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], {step})), 4294967295)"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce('s' || source, '-') AS tree, {leaf("text")} AS h, CASE WHEN doc_id IS NULL OR crc % 2 = 1 THEN {leaf("text")} ELSE {leaf("replace(text, chr(10), '')")} END AS now
  FROM (SELECT *, {crc} AS crc FROM documents)),
lf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, now) - 1 AS pos FROM d),
{tree("lf", "tree")},
sr AS MATERIALIZED (SELECT 0 AS whole, tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h FROM lftop),
{tree("sr", "whole")},
{climb("lf", "tree", "now")},
{climb("sr", "whole", "h")},
src AS (SELECT sr.tree, sr.pos, sr.h AS subroot, srf.proof, srtop.h AS root FROM sr JOIN srf USING (pos), srtop),
j AS (SELECT lf.doc_id, lf.h AS leaf, subroot, root, sha256(lff.proof || src.proof) AS proof_sha256, lff.h AS below, src.pos AS pos FROM lf JOIN lff USING (tree, pos) JOIN src USING (tree)),
up AS (WITH RECURSIVE f AS (SELECT row_number() OVER () AS r, doc_id, leaf, subroot, root, proof_sha256, pos, 0 AS l, below AS h FROM j
  UNION ALL SELECT f.r, doc_id, leaf, subroot, root, proof_sha256, pos // 3, f.l + 1, sha256(array_to_string(hs[:pos % 3], '') || h || array_to_string(hs[pos % 3 + 2:], ''))
  FROM f JOIN srruns r ON r.l = f.l AND r.run = f.pos // 3)
  SELECT r, doc_id, leaf, subroot, root, proof_sha256, arg_max(h, l) AS folded_root FROM f GROUP BY ALL)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM up"""


ORACLE_SQL["op12_clusters"] = _cluster_sql()
ORACLE_SQL["op13_merkle_manifest"] = _merkle_sql()
