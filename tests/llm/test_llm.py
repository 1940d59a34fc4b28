"""The training-data operators against brute force, and their edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.llm import bktree, chat, components, exact_dedup, fingerprint, html_text, mixing, near_dedup, packing, token_spans, toxicity, warc
from attesta.llm.common import fresh_path
from attesta.llm.queries import tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, id long, key string"


def make(spark, texts, sources=None):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", (sources or ["s0", "s1", None])[i % len(sources or [0, 1, 2])], 0, -1, -2, "x") for i, t in enumerate(texts)], DOC)


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, rng.randrange(1, 400)) for _ in range(30)]
    near = []
    for t in base[:8]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    return base + near + base[:6] + ["", None, "  \n\t ", "One", "one", words(rng, 9000), "é " * 50]


def test_html():
    t = html_text.page_text("<title>no</title><p>a<p>b<ul><li>x<li>y<ol start=3><li>z</ol></ul><table><tr><td>aa<td>b<tr><td>c<td>d</table><p style='display:none'>no<script>no</script>&lt;e")
    assert t == "a\n\nb\n\n* x\n* y\n  3. z\n\naa  b\nc   d"  # the script in the hidden paragraph hides what follows with it
    assert html_text.page_text("") == "" and "deep" in html_text.page_text("<div>" * 3000 + "deep")
    assert "in" in html_text.page_text("<ul><li>" * 200 + "in")
    assert html_text.page_text("<p hidden>x</p>y") == "y" and html_text.page_text("<pre> a\n  b</pre>").split("\n") == [" a", "  b"]


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, "u", "<b>x</b>"), (2, "u", "<b>x</b>")], "page_id long, url string, html string")
    assert sorted(tuple(r) for r in html_text.extract_text(pages).collect()) == [(1, ""), (2, "x"), (2, "x")]


def test_chat(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice([None, "", "\\l</s>\\", "[INST] x [/INST]<<SYS>>", words(rng, 300)])) for c in range(12) for t in range(rng.randrange(1, 30))]
    rows += [(None, 0, "user", "n"), (3, 0, None, "null role"), (3, 0, None, "null role")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.chat_windows(df, budget=900, history=200)
    assert windows.where("tokens > 900").count() <= sum(len(r[3] or "") / 4 + 9 > 300 for r in rows)
    got = {r.conv_id: r for r in chat.conversation_digests(windows).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_windows(df.limit(0)).count() == 0


def test_marginals_are_forward_backward():
    chain, rng = np.array([-0.1, -3.0, -0.5, -1.0]), np.random.default_rng(0)
    us = [rng.normal(0, 3, n) for n in (0, 1, 64, 65, 200)]
    got = np.split(toxicity.marginals(np.concatenate(us), np.array([len(u) for u in us]), chain), np.cumsum([len(u) for u in us])[:-1])
    a = np.exp(chain).reshape(2, 2)
    for u, g in zip(us, got):
        f, v = [], np.array([1.0, 0.0])
        for x in u:
            v = (v @ a) * [1, np.exp(x)]
            v /= v.sum()
            f.append(v)
        b = np.ones(2)
        for i in range(len(u) - 1, -1, -1):
            p = f[i] * b
            assert abs(p[1] / p.sum() - g[i]) < 1e-9
            b = a @ (np.array([1, np.exp(u[i])]) * b)
            b /= b.sum()


def test_toxicity(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, 60) + (" vileword nasty " * 2 + words(rng, 20) if i % 3 == 0 else "")) for i in range(300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit_on(docs, labels)
    scored = {r.doc_id: r for r in toxicity.score_texts(docs, model).collect()}
    assert all((scored[i].score >= 0.5) == (i % 3 == 0) for i in range(300)) and scored[300].score < 0.5
    assert {dict(rows)[0][s.start : s.stop] for s in scored[0].spans} <= {"vileword nasty", "vileword", "nasty", "vileword nasty  vileword nasty"}
    assert {r.doc_id for r in toxicity.keep_clean(docs, model).collect()} == {i for i, _ in rows if scored[i].score < 0.5}
    assert toxicity.score_texts(docs, toxicity.fit_on(docs, labels.limit(0))).agg(F.max("score")).first()[0] == 0.0


def test_fingerprints(spark, texts):
    docs = make(spark, texts)
    got = {r.doc_id: r for r in fingerprint.document_fingerprints(docs).collect()}
    n = len(texts)
    assert len(got) == n
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1] or ""  # descending ids; after the smallest comes the largest
        new = fingerprint.edited(t, nxt)
        known = fingerprint.WordHashes()
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert got[i].fingerprint == fingerprint.fingerprint(t, known).hex() and got[i].edited_fingerprint == fingerprint.fingerprint(new, known).hex()
        assert got[i].near_next == fingerprint.likeness(bytes.fromhex(got[i].fingerprint), bytes.fromhex(got[(i - 1) % n].fingerprint))
    one = fingerprint.document_fingerprints(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprint.document_fingerprints(docs.limit(0)).count() == 0


def test_permuted_tables_find_all(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (20, 32), dtype=np.uint8)
    rows = []
    for b in base:
        for k in (0, 3, 7, 9):
            bits = np.unpackbits(b)
            bits[rng.choice(256, k, replace=False)] ^= 1
            rows.append(np.packbits(bits).tobytes().hex())
    df = spark.createDataFrame([(r,) for r in rows], "fingerprint string")
    got = {(r.query, r.match, r.bits) for r in fingerprint.find_near(df, df).collect()}
    d = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert got == {(a, b, d(a, b)) for a in set(rows) for b in set(rows) if d(a, b) <= 7}


def brute_components(keys, radius):
    parent = list(range(len(keys)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(keys)):
        for b in range(a):
            if (keys[a] ^ keys[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(keys))]


def test_forest():
    rng = np.random.default_rng(1)
    k = rng.integers(0, 2**63, 15, dtype=np.uint64)[rng.integers(0, 15, 250)]
    for _ in range(5):
        k = k ^ (np.uint64(1) << rng.integers(0, 64, 250).astype(np.uint64))
    assert bktree.Forest(k, np.zeros(250, int), 4).components().tolist() == brute_components([int(x) for x in k], 4)


@pytest.mark.parametrize("cap", [65_536, 5])
def test_simhash_components(spark, texts, cap):
    got = {r.doc_id: r for r in near_dedup.simhash_components(make(spark, texts), shard_cap=cap).collect()}
    keys = [near_dedup.simhash(near_dedup.shingle_hashes(t, 4)) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == keys
    assert [got[i].component_id for i in range(len(texts))] == brute_components(keys, 4)
    assert near_dedup.simhash_components(make(spark, texts).limit(0)).count() == 0


def test_near_dedup(spark, texts):
    docs = make(spark, texts)
    kept = near_dedup.drop_near(docs)
    assert kept.columns == docs.columns
    sets = [set(near_dedup.shingle_hashes(t, 5).tolist()) for t in texts]
    keep = [i for i, s in enumerate(sets) if not s or not any(len(s & o) >= 0.8 * len(s | o) for o in sets[:i] if o)]
    assert sorted(r.doc_id for r in kept.collect()) == keep


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)]
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: c for x, c in label.items() if x in got} and all(a == b for a, b in edges if a not in got)


def test_exact(spark, texts):
    docs = make(spark, texts)
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    for keep, pick in (("smallest", min), ("largest", max)):
        got = {r.doc_id: r for r in exact_dedup.exact_groups(docs, keep=keep).collect()}
        for t, ids in groups.items():
            for i in ids:
                assert tuple(got[i])[1:] == (pick(ids), len(ids), i == pick(ids), hashlib.sha256(t.encode()).hexdigest())
        assert sorted(r.doc_id for r in exact_dedup.drop_exact(docs.unionByName(docs), keep=keep).collect()) == sorted(map(pick, groups.values()))


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for limits in ({}, {"max_tokens": 100, "max_segments": 3, "max_loss": 60}):
        rows = packing.pack(make(spark, texts).coalesce(1), lambda: packing.WordTokenizer(path), **limits).collect()
        docs, sequences = collections.defaultdict(list), collections.defaultdict(list)
        for r in rows:
            docs[r.doc_id].append(r)
            sequences[r.sequence_id].append(r)
        for i, x in enumerate(texts):
            ids, at = [*t.encode(x or "", add_special_tokens=False).ids, 2], 0
            for r in sorted(docs[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids)
        for s in sequences.values():
            s.sort(key=lambda r: r.offset)
            assert [r.offset for r in s] == np.cumsum([0, *[r.length for r in s]])[:-1].tolist()
            assert sum(r.length for r in s) <= limits.get("max_tokens", 4096) and len(s) <= limits.get("max_segments", 16) and sum(r.loss_tokens for r in s) <= limits.get("max_loss", 4096)


def test_mixing(spark, texts):
    docs = make(spark, texts, ["b", "a", None, "c", "a"])
    size = [len((t or "").split()) for t in texts]
    rows = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert [rows[i].size for i in range(len(texts))] == size and all(r.taken <= 2 * r.size for r in rows.values())
    source = [["b", "a", None, "c", "a"][i % 5] for i in range(len(texts))]
    for s in set(source):
        mine = [rows[i] for i in range(len(texts)) if source[i] == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5 and mine[0].target <= 2 * mine[0].source_size + 1e-9
    assert abs(sum(r.taken for r in rows.values()) - 1.5 * sum(size)) <= len(set(source))
    again = mixing.mixed_documents(docs)
    took = collections.Counter()
    for r in again.collect():
        took[r.doc_id] += len((r.text or "").split())
    assert again.columns == docs.columns and {i: r.taken for i, r in rows.items() if r.taken} == {i: n for i, n in took.items() if n}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_without_ids(spark):
    """Many rows without an id or of one id: no bucket holds a large share, each source reaches its target, and reruns agree."""
    rng = random.Random(9)
    texts = [" ".join(["w"] * rng.randrange(1, 30)) + f" {i}" for i in range(3000)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t, ["a", None][i % 2]) for i, t in enumerate(texts)]
    rows += [(None, "same text", "a")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mixed = mixing.mix(docs)
    got = mixed.collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    for size in {r.source_size for r in got}:
        mine = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5
    order = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=order) == sorted(mixing.mix(docs.repartition(3)).collect(), key=order)
    hashed = docs.withColumn("b", F.substring(mixing._hash(F.col("doc_id"), F.col("text")), 1, mixing.BUCKET_DIGITS)).groupBy("source", "b").count()
    assert hashed.agg(F.max("count")).first()[0] <= 42  # the equal rows, and few by chance
    taken = collections.Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert taken[None] >= sum(r.passes for r in got if r.doc_id is None)


def test_warc(spark):
    big = "WARC/1.1\r\n\r\n\r\n" * 20
    rows = [(5, "u", big), (2, "u\r\nx", big), (9, None, big), (1, "u", None), (3, "u", "short"), (4, "u", "short"), (6, "u", "é" * 60)]
    path = fresh_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r.page_id: tuple(r)[1:] for r in warc.resolved(warc.read_archives(spark, path)).collect()}
    for i, _, html in rows:
        body = (html or "").encode()
        again = html == big and i != 2
        assert got[i] == (len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", 2 if again else None)


def test_token_spans(spark, texts):
    import public_tokenizers

    make_tokens = lambda: token_spans.ByteTokenizer(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    lines = [None if t is None else t.replace(" b", "\n\nb") for t in texts]
    got = collections.defaultdict(list)
    for r in token_spans.section_tokens(make(spark, lines), make_tokens).collect():
        got[r.doc_id].append(r)
    ends_of = make_tokens()
    for i, t in enumerate(lines):
        t = t or ""
        rows = sorted(got[i], key=lambda r: r.section)
        assert "".join(t[r.start : r.stop] for r in rows) == t and sum(r.n_tokens for r in rows) == len(ends_of(t))
        assert [t[r.start : r.stop] for r in rows] == (t.splitlines(keepends=True) if t and "\r" not in t else [""])
    assert token_spans.attribute(np.array([2, 6, 7]), np.array([0, 3, 3, 7]))[0].tolist() == [1, 0, 2]


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= (2 * n if name == "source_mix" else n)
        n = docs.count()
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_leaves_no_tokenizer_in_workers(spark):
    import corpus_pipeline

    docs = make(spark, ["one two three", None, "four"] * 20)
    assert corpus_pipeline.pack_sequences(spark, docs, "").count() == 60

    def held(batches):
        import gc

        for _ in batches:
            found = [x for x in gc.get_objects() if isinstance(x, packing.WordTokenizer) and x.words.most < packing.CACHE_WORDS // 2]
            yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64())], ["n"])

    assert {r.n for r in spark.range(8).repartition(8).mapInArrow(held, "n long").collect()} == {0}


def test_word_tokenizers_of_a_file_load_it_once():
    one, two = (packing.WordTokenizer(tokenizer_path("word_bpe_49k.json"), n, n) for n in (100, 200))
    assert one.tokenizer is two.tokenizer and one.words is not two.words
    assert one("One two-three é").tolist() == two("One two-three é").tolist()


def test_near_features_come_in_bounded_steps(spark):
    """What a task holds of features does not grow with the batches that it is given."""

    class Caught:
        def select(self, *columns):
            return self

        def mapInArrow(self, work, schema):  # noqa: N802
            return work

    rng = random.Random(4)
    texts = [words(rng, 8) for _ in range(1300)]
    work = near_dedup._features(Caught(), "doc_id", "text", 5, 10, 3)
    given = pa.RecordBatch.from_arrays([pa.array(range(1300), pa.int64()), pa.array(texts)], ["id", "t"])
    got = list(work(iter([given])))
    assert max(b.num_rows for b in got) <= 500
    sketches = {i: s for b in got for i, s in zip(b.column(0).to_pylist(), b.column(3).to_pylist())}
    assert sketches == {i: np.unique(near_dedup.shingle_hashes(t, 5)).tobytes() for i, t in enumerate(texts)}


def test_screen_passes_every_similar_pair():
    rng = np.random.default_rng(3)
    for size in (4, 40, 200, 256, 300, 900):
        base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        sets = [base]
        for share in (0.02, 0.05, 0.1, 0.11, 0.2, 0.5):
            cut = rng.random(len(base)) >= share
            sets += [base[cut], np.unique(np.r_[base[cut], rng.integers(0, 1 << 63, (~cut).sum(), dtype=np.uint64)])]
        table = pa.table({"sketch": [s[:256].tobytes() for s in sets]})
        verify, screen = near_dedup._similar(256, 0.8)(table)
        a, b = (x.ravel() for x in np.mgrid[: len(sets), : len(sets)])
        alike = verify(a, b)
        assert alike.any() and screen(a, b)[alike].all()


def test_near_dedup_of_long_texts_is_exact(spark):
    """Pairs of 600 to 1,600 shingles just above and just below the threshold."""
    rng = random.Random(11)
    texts = []
    for k in range(24):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(600, 1600))]
        similarity = 0.805 if k % 2 else 0.79
        cut = round(len(w) * 2 * similarity / (1 + similarity))  # the words after it are replaced
        texts += [" ".join(w), " ".join(w[:cut] + [f"x{rng.randrange(10**6)}" for _ in w[cut:]])]
    sets = [set(near_dedup.shingle_hashes(t, 5).tolist()) for t in texts]
    keep = [i for i, s in enumerate(sets) if not any(len(s & o) >= 0.8 * len(s | o) for o in sets[:i])]
    assert len(keep) == 36
    assert sorted(r.doc_id for r in near_dedup.drop_near(make(spark, texts)).collect()) == keep


def test_near_dedup_ignores_repeats(spark):
    """Near copies stay near copies however often one of them repeats a line."""
    rng = random.Random(12)
    texts = []
    for times in (1, 10, 20, 60, 200):
        w = [f"w{rng.randrange(10**6)}" for _ in range(304)]
        texts += [" ".join(w), " ".join(w + w[:6] * times)]
    sets = [set(near_dedup.shingle_hashes(t, 5).tolist()) for t in texts]
    keep = [i for i, s in enumerate(sets) if not any(len(s & o) >= 0.8 * len(s | o) for o in sets[:i])]
    assert keep == [0, 2, 4, 6, 8]
    assert sorted(r.doc_id for r in near_dedup.drop_near(make(spark, texts)).collect()) == keep


def test_html_head_without_end_tag():
    assert html_text.page_text("<html><head><title>T</title><p>Hello") == "Hello"
    assert html_text.page_text("<head><meta charset=utf-8><style>s</style> <script>x</script>\n Hello <b>you</b>") == "Hello you"
    assert html_text.page_text("<head><title>T</title><link rel=a><noscript>n</noscript></head><body>x") == "x"
    assert html_text.page_text("<head> <title>T</title>") == ""


def test_warc_null_and_repeated_ids(spark):
    big = "<p>page</p>" * 20
    rows = [(None, "u", big), (None, None, "short"), (None, "u", None), (7, "u", big), (7, "u", big + "2"), (7, "v", "short"), (8, "u", big)]
    path = fresh_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    records = warc.read_archives(spark, path)
    assert records.select("record_id").distinct().count() == len(rows)
    got = collections.Counter(tuple(r) for r in warc.resolved(records).collect())
    kind = lambda i, html: ("revisit", 7) if i == 8 else ("response", None)
    assert got == collections.Counter((i, len(h or ""), hashlib.sha256((h or "").encode()).hexdigest(), *kind(i, h)) for i, _, h in rows)


def test_html_fields_formulas_and_diagrams():
    assert html_text.page_text("a<select><option>one<option selected>two<option>three</select>b") == "a two b"
    assert html_text.page_text("<select><optgroup><option>one<option>two</select>") == "one"
    assert html_text.page_text("<select multiple><option>one<option>two</select>") == "one two"
    assert html_text.page_text("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>") == "x=1"
    assert html_text.page_text("<svg><defs/><title>no</title><text>up</text><path d='a'/><text>down</text><desc>no</desc></svg>z") == "up down z"
    deep = html_text.page_text("<ul><li>" * 70 + "a<br>b<hr><img alt=c><input value=d><p>e</p><select><option>f</select><svg><desc>no</desc><text>g</text></svg>")
    assert [x.strip() for x in deep.split("\n")[-9:]] == ["b", "", "---", "", "c d", "", "e", "", "f g"]  # spaced as at any depth


def test_packing_with_prompts_and_without_cuts(spark):
    """All three limits bind: prompts bear no loss, and examples that may not be cut stay whole."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([1, 2, 3, 40, 60]))), rng.choice([None, 0, 5, 1000])) for i in range(400)]
    docs = spark.createDataFrame([*rows, (5, rows[5][1], rows[5][2]), (None, None, None)], "doc_id long, text string, p long").coalesce(1)
    make_ids = lambda: lambda text: np.arange(len(text.split()), dtype=np.uint32)
    limits = {"max_tokens": 120, "max_segments": 6, "max_loss": 90}
    for cut in (False, True):
        got = packing.pack(docs, make_ids, prompt_col="p", cut=cut, **limits).collect()
        sequences = collections.defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append(r)
        bound = collections.Counter()
        for s in sequences.values():
            total = (sum(r.length for r in s), len(s), sum(r.loss_tokens for r in s))
            assert total <= (120, 6, 90) and total[1] <= 6 and total[2] <= 90
            bound.update(k for k, (x, m) in enumerate(zip(total, (120, 6, 90))) if x == m)
        assert bound[1] and (not cut or bound[0] and bound[2])
        lengths = {i: (len(t.split()) + 1, p or 0) for i, t, p in rows} | {None: (1, 0)}
        pieces = collections.defaultdict(list)
        for r in got:
            pieces[r.doc_id].append(r)
            n, p = lengths[r.doc_id]
            assert r.doc_tokens == n and r.loss_tokens == max(0, r.start + r.length - max(r.start, p))
            assert cut or (r.start, r.length) == (0, n)
        assert {i: sum(r.length for r in x) for i, x in pieces.items()} == {i: n * (2 if i == 5 else 1) for i, (n, _) in lengths.items()}
    with pytest.raises(Exception, match="may not be cut"):
        packing.pack(docs, make_ids, cut=False, max_tokens=30).collect()
    assert packing.pack(docs.limit(0), make_ids).count() == 0


def test_tokenizer_equals_the_library_on_odd_strings():
    rng, path = random.Random(1), tokenizer_path("word_bpe_49k.json")
    signs = "aAzZéÉßİıΣσςǅ'’-_.,<|>1٣²½ \t\n\x0b\x0c\x1c\x1f\x85\xa0 　́̇가가ｆ\U0001d400\U0001f600ꙮ中"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(4000)] + ["<|endoftext|>x", "don't 're 'LL", ""]
    mine = packing.WordTokenizer(path)
    mine.words.most, mine.runs.most = 500, 300  # what is set aside comes back right
    got = [i for start in range(0, len(texts), 100) for i in mine.many(texts[start : start + 100])]
    assert [x.tolist() for x in got] == [mine.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_toxicity_clashing_and_repeated_rows(spark):
    """Columns named as the operator's own, repeated ids and labels, and long texts neither fail nor widen the sample."""
    rng = random.Random(1)
    rows = [(i, words(rng, 60) + (" vileword nasty " * 2 if i % 3 == 0 else ""), 1, 1, "x", 0) for i in range(200)]
    rows += [rows[3]] * 500 + [(None, "x", 0, 0, "", 0), (400, "long " * 300_000, 0, 0, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _y int, t string, i int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] * 3 + [(None, 1), (5, None), (400, 1)], "doc_id long, toxic int")
    taken = []
    fit, toxicity.fit = toxicity.fit, lambda t, y: taken.append((t, y)) or fit(t, y)
    try:
        model = toxicity.fit_on(docs, labels)
    finally:
        toxicity.fit = fit
    assert len(taken[0][0]) == sum(zlib.crc32(str(i).encode()) % 5 != toxicity.HELD_OUT for i in range(200))
    got = toxicity.score_texts(docs, model).collect()
    assert len(got) == len(rows) and all((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 200)
    assert toxicity.score_texts(docs.limit(0), model).count() == 0 and toxicity.keep_clean(docs, model).columns == docs.columns


def test_warc_shuffled_decisions_and_odd_rows(spark):
    """The join by shuffle gives what the broadcast gives; repeated rows, extra columns and an empty table."""
    rng = random.Random(4)
    bodies = ["<p>" + words(rng, 40) for _ in range(5)] + ["short", None, "WARC/1.1\r\n\r\n" * 30]
    rows = [(rng.choice([None, *range(30)]), "u", rng.choice(bodies), 1, "x") for _ in range(80)] + [(3, "u", bodies[0], 1, "x")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, bytes int, digest string")
    got = []
    for most in (10**6, 0):
        path = fresh_path(spark, "warc")
        warc.write_archives(pages, path, date="2020-01-01T00:00:00Z", broadcast_rows=most)
        got.append(sorted(map(str, warc.resolved(warc.read_archives(spark, path)).collect())))
    assert got[0] == got[1] and len(got[0]) == len(rows)
    first = collections.defaultdict(lambda: 10**9)
    for i, _, h, *_ in rows:
        if i is not None:
            first[h] = min(first[h], i)
    want = []
    for i, _, h, *_ in rows:
        body = (h or "").encode()
        again = len(body) >= 100 and i is not None and i > first[h]
        want.append(str((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[h] if again else None)))
    assert sorted(str(tuple(r)) for r in warc.resolved(warc.read_archives(spark, path)).collect()) == sorted(want)
    path = fresh_path(spark, "warc")
    warc.write_archives(pages.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0
    plan = pages.sparkSession.read.text(path)  # plain members read as well
    assert plan.count() == 0 and [h["a"] for h, _ in warc.records_of(b"WARC/1.1\r\nA: 1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")] == ["1"]


def naive_text(children):
    """The lines of a tree of (tag, children) and strings, by plain recursion."""
    marks = []  # ("text", s), ("line",), ("blank",), ("put", lines)
    for c in children:
        if isinstance(c, str):
            marks.append(("text", c))
            continue
        tag, inner = c
        if tag == "br":
            marks.append(("force",))
        elif tag in ("ul", "ol"):
            rows = []
            for k, (_, x) in enumerate(inner, 1):
                m = f"{k}. " if tag == "ol" else "* "
                body = naive_text([("in-item", x)]) or [""]
                rows += [((m if i == 0 else " " * len(m)) + s).rstrip() if s or i == 0 else "" for i, s in enumerate(body)]
            marks += [("around",), ("put", rows), ("around",)]
        elif tag == "table":
            cells = [[naive_text(x) for _, x in row] for _, row in inner]
            wide = [max((len(s) for row in cells if k < len(row) for s in row[k]), default=0) for k in range(max(map(len, cells)))]
            full = [k for k in range(len(wide)) if any(k < len(row) and row[k] for row in cells)]
            rows = ["  ".join((row[k][i] if k < len(row) and i < len(row[k]) else "").ljust(wide[k]) for k in full).rstrip() for row in cells for i in range(max(map(len, row)))]
            marks += [("blank",), ("put", rows), ("blank",)]
        elif tag == "blockquote":
            marks += [("blank",), ("put", [("    " + s).rstrip() for s in naive_text(inner)]), ("blank",)]
        elif tag == "in-item":
            return naive_fold(naive_marks(inner), "line")
        else:
            edge = {"p": "blank", "div": "line"}.get(tag)
            some = naive_marks(inner)
            marks += [(edge,), *some, (edge,)] if edge else some
    return naive_fold(marks, "blank")


def naive_marks(children):
    """The marks of children, so that inline and block elements do not start a sheet of their own."""
    out = []
    for c in children:
        if isinstance(c, str):
            out.append(("text", c))
        elif c[0] in ("p", "div", "b"):
            edge = {"p": "blank", "div": "line"}.get(c[0])
            out += [(edge,), *naive_marks(c[1]), (edge,)] if edge else naive_marks(c[1])
        elif c[0] == "br":
            out.append(("force",))
        else:
            out += [("around" if c[0] in ("ul", "ol") else "blank",), ("put", naive_text([c])), ("around" if c[0] in ("ul", "ol") else "blank",)]
    return out


def naive_fold(marks, around):
    lines, now, blank = [], "", False

    def end(force=False):
        nonlocal now, blank
        s = " ".join(now.split())
        if s or force:
            lines.extend([""] if blank and lines else [])
            lines.append(s)
            blank = False
        now = ""

    for kind, *x in marks:
        kind = around if kind == "around" else kind
        if kind == "text":
            now += x[0]
        elif kind == "put":
            end()
            for s in x[0]:
                lines.extend([""] if blank and lines else [])
                lines.append(s)
                blank = False
        else:
            end(kind == "force")
            blank = blank or kind == "blank"
    end()
    return lines


def test_html_against_plain_recursion():
    rng = random.Random(9)

    def tree(depth):
        out = []
        for _ in range(rng.randrange(1, 4)):
            tag = rng.choice(["text"] * 3 + ["b", "p", "div", "br"] + (["ul", "ol", "blockquote", "table"] if depth else []))
            if tag == "text":
                out.append(rng.choice(["one ", " two", "three", "a  b", "long words here "]))
            elif tag in ("ul", "ol"):
                out.append((tag, [("li", tree(depth - 1)) for _ in range(rng.randrange(1, 3))]))
            elif tag == "table":
                out.append((tag, [("tr", [("td", tree(depth - 1)) for _ in range(rng.randrange(1, 4))]) for _ in range(rng.randrange(1, 4))]))
            elif tag == "b" or not depth:
                out.append(("b", ["bold"]) if tag != "br" else ("br", []))
            else:
                out.append((tag, [] if tag == "br" else [x for x in tree(depth - 1) if tag != "p" or isinstance(x, str)]))
        return out

    def html(children):
        return "".join(c if isinstance(c, str) else "<br>" if c[0] == "br" else f"<{c[0]}>{html(c[1])}</{c[0]}>" for c in children)

    for _ in range(600):
        t = tree(3)
        lines = []
        for s in naive_fold(naive_marks(t), "blank"):
            if s or (lines and lines[-1]):
                lines.append(s)
        assert html_text.page_text(html(t)) == "\n".join(lines).strip("\n"), html(t)


def test_html_fields_dialogs_and_bars():
    """Values that a browser shows in fields of any type, and what it does not draw."""
    kinds = "email search url tel number date time month week datetime-local text submit button reset unknown".split()
    shown = "".join(f"<input type={k} value=v-{k}>" for k in kinds)
    assert html_text.page_text(shown).split() == [f"v-{k}" for k in kinds]
    assert html_text.page_text("".join(f"<input type={k} value=no>" for k in sorted(html_text.WORDLESS)) + "<input type=' IMAGE ' alt=yes>") == "yes"
    assert html_text.page_text("a<dialog>no</dialog><dialog open>b</dialog>c") == "a\nb\nc"
    assert html_text.page_text("<style>dialog{display:block}</style><dialog>styled</dialog>") == "styled"
    assert html_text.page_text("<style>p{display:block}</style>a<dialog>no</dialog>") == "a"
    assert html_text.page_text("a <progress max=2>no</progress> <meter value=1>no <b>no</b></meter> b") == "a b"


def test_html_nested_tables_with_text_and_many_rules():
    import time

    began = time.time()
    depth = 20_000
    lines = html_text.page_text("".join(f"<table><tr><td>t{i}" for i in range(depth))).split("\n")
    assert [x for x in lines if x] == [f"t{i}" for i in range(depth)]
    rules = "".join(f".c{'.d' * (i % 3)} {{display: block}}" for i in range(3000))
    assert html_text.page_text(f"<style>{rules} .c.hide {{display: none}}</style>" + "<b class=c>x</b><b class='c hide'>y</b>" * 3000).count("y") == 0
    assert time.time() - began < 30


def test_html_depth_and_time():
    import time

    deep = html_text.page_text("<ul><li>" * 500 + "a<br>b<hr><img alt=ALT><input value=VAL><table><tr><td>c<td>d<tr><td>ee<td>f</table>")
    assert [x.strip() for x in deep.split("\n")[1:]] == ["b", "", "---", "", "ALT VAL", "", "c   d", "ee  f"] and deep.startswith("* " * 500 + "a")
    began = time.time()
    for page in ("<div>" * 100_000, "<ul><li>" * 50_000, "<p><button>" + "<span>" * 50_000 + "<div>" * 50_000, "<table><tr><td>" * 5_000):
        assert html_text.page_text(page + "end").strip(" *") == "end"
    assert time.time() - began < 60


def test_html_visibility_and_spans():
    page = "<style>.gone, p.x { display: none } #b{visibility:hidden} .back{visibility:visible} @media print {.y{display:none}}</style>"
    assert html_text.page_text(page + "<p class=x>1<p class='y gone'>2<p class=y>3<div class=x>4</div><div id=b>5<b class=back>6</b></div>") == "3\n\n4\n6"
    assert html_text.page_text("<style>.a{display:none}</style><p class=a style='display:block'>1") == "1"
    assert html_text.page_text("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>") == "s\nt\nyes"
    assert html_text.page_text("<blockquote><pre>\na  b\n c</pre></blockquote>") == "    a  b\n     c"
    assert html_text.page_text("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>d<td>e</table>") == "a  b\n   c\nd     e"
    wide = "w" * 300
    assert html_text.page_text(f"<table><tr><td>{wide}<td>x<tr><td>s<td>y</table>").split("\n") == [wide + "  x", "s" + " " * 301 + "y"]
    assert html_text.page_text("<ol start=99999999999999><li>a</ol><ol><li value=-3>b<li>c</ol>") == "2147483647. a\n\n-3. b\n-2. c"


def test_html_table_edges(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a" * 50_000, "x", 1), (2, None, None, None, None)], "page_id long, url string, html string, id string, h int")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert got[2] == "" and got[1] == "\n\n".join("a" * 50_000)
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_training_order_survives_to_packing(spark):
    import corpus_pipeline
    from attesta.llm.common import materialize

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        mixed = corpus_pipeline.mix_sources(spark, docs, sf)
        written, _ = materialize(mixed, "stage")
        want = mixed.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()).orderBy("row").collect()
        got = corpus_pipeline.in_file_order(written).withColumn("row", F.monotonically_increasing_id()).orderBy("row").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [(r.doc_id, r.text) for r in got] == [(r.doc_id, r.text) for r in want]
    position = {r.doc_id: r.position for r in mixing.mix(docs).collect()}
    seen = set()
    firsts = [position[i] for i in (r.doc_id for r in got) if i not in seen and not seen.add(i)]
    assert firsts == sorted(firsts)  # first copies stand in the order of the schedule
    part = {i: k for k, i in ((r.part, r.doc_id) for r in want)}
    packed = corpus_pipeline.pack_sequences(spark, written, sf).collect()
    once = {r.doc_id for r in want} - {r.doc_id for k, r in enumerate(want) if any(x.doc_id == r.doc_id for x in want[:k])}
    assert once and all((r.sequence_id >> 40) == part[r.doc_id] for r in packed if sum(x.doc_id == r.doc_id for x in want) == 1)


def greedy_windows(turns, budget, history, segment):
    """(turns, repeated, tokens) of each window, one turn after the other: the rule of chat_windows in plain Python."""
    cost = [-(-len(text.encode()) // 4) + chat.TURN_OVERHEAD for _, text in turns]
    system = next((i for i, t in enumerate(turns) if t[0] == "system"), None)
    out, i = [], 0
    while i < len(turns):
        held = cost[system] if system is not None and system < i else 0
        spare = budget - held - cost[i]
        k = i
        while k and i - k < history and sum(cost[k - 1 : i]) <= min(history, spare):
            k -= 1
        if k == i and i and turns[i][0] == "assistant" and cost[i - 1] <= spare:
            k = i - 1
        room, end = max(budget - held, budget // chat.LEAST_SHARE) - sum(cost[k:i]), i + 1
        while end < len(turns) and end % segment and sum(cost[i : end + 1]) <= room:
            end += 1
        repeated = [j for j in range(k, i) if j != system]
        repeated = [system] * bool(held) + repeated
        out.append((i, [turns[j] for j in repeated], turns[i:end], sum(cost[j] for j in [*repeated, *range(i, end)])))
        i = end
    return out


@pytest.mark.parametrize("segment", [7, 4096])
def test_chat_windows_against_brute_force(spark, segment):
    """Long system turns stay, prompts stay with their answers, and windows take all turns that fit."""
    rng = random.Random(3)
    rows = []
    for c in range(25):
        size = 4 * rng.choice([5, 30, 150])
        if c % 3:
            rows.append((c, rng.choice([0, 0, 5]), "system", "s" * rng.choice([40, 400, 1600])))
        for t in range(1, rng.randrange(2, 40)):
            rows.append((c, t, "assistant" if t % 2 == 0 else "user", "x" * rng.choice([size, size, 4 * rng.randrange(1, 420), 3000 if c % 5 == 0 else 1])))
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, n int")
    budget, history = 600, 80
    got = collections.defaultdict(list)
    for r in chat.read_windows(chat.chat_windows(df, budget=budget, history=history, segment=segment)).collect():
        got[r.conv_id].append(r)
    for c in {r[0] for r in rows}:
        turns = [(role, text) for _, _, role, text in sorted(r for r in rows if r[0] == c)]
        have = []
        for w in sorted(got[c], key=lambda w: w.window):
            context = [(p[len(chat.OPEN) : p.index(chat.CLOSE)], p[p.index(chat.CLOSE) + len(chat.CLOSE) :]) for p in w.text.split(chat.END)[: w.repeated]]
            have.append((w.window, context, [tuple(t) for t in w.turns], w.tokens))
            assert list(w.loss_texts) == [t.text for t in w.turns if t.role == "assistant"]
        assert have == greedy_windows(turns, budget, history, segment)


def test_chat_windows_are_full(spark):
    """Turns near half of a window, and of a quarter with some near half among them, leave no window half empty."""
    turn = lambda c, t, tokens: (c, t, "assistant" if t % 2 else "user", "x" * 4 * (tokens - chat.TURN_OVERHEAD))
    rows = [turn(1, t, 1700) for t in range(60)] + [turn(2, t, 900 if t % 9 else 1750) for t in range(90)]
    windows = chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: (r.n, r.fill) for r in windows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), (F.avg("tokens") / chat.BUDGET).alias("fill")).collect()}
    assert got[1][0] == 30 and all(fill > 0.8 for _, fill in got.values())


def test_chat_sql_over_many_windows(spark, tmp_path):
    """The query's SQL on conversations of several windows, null roles and texts, and the empty table."""
    import duckdb

    from attesta.llm import queries

    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "</s>", "é" * 700, "y" * rng.choice([40, 3000, 7000, 17000])])) for c in range(12) for t in range(rng.randrange(1, 30))]
    for name, part in (("many", rows), ("none", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(part, "conv_id long, turn long, role string, text string").write.parquet(f"{sf}/conversations.parquet")
        got = queries.op2_chat_format(spark, sf)
        con = duckdb.connect()
        con.sql(f"create view conversations as select * from '{sf}/conversations.parquet/*.parquet'")
        want = con.sql(queries.ORACLE_SQL["op2_chat_format"])
        names = want.columns
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_token_spans_against_brute_force(spark, texts):
    """Every token by itself: the section that holds most of its bytes, the earlier one of equals."""
    import public_tokenizers

    make_tokens = lambda: token_spans.ByteTokenizer(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoding = make_tokens().encoding
    rng = random.Random(6)
    lines = [None if t is None else "".join("\n" if rng.random() < 0.04 else c for c in t[:3000]) for t in texts] + ["é\n\n\nü€\n", "\n", "a\r\n b"]

    def expected(parts):
        ends, at = [], 0
        for p in parts:
            at += len(p.encode())
            ends.append(at)
        starts = [0, *ends[:-1]]
        count, crossing, at = [0] * len(parts), [0] * len(parts), 0
        for token in encoding.encode_ordinary("".join(parts)):
            stop = at + len(encoding.decode_single_token_bytes(token))
            share = [max(0, min(e, stop) - max(s, at)) for s, e in zip(starts, ends)]
            of = share.index(max(share))
            count[of] += 1
            crossing[of] += sum(x > 0 for x in share) > 1
            at = stop
        return list(zip(count, crossing))

    got = collections.defaultdict(list)
    for r in token_spans.section_tokens(make(spark, lines), make_tokens).collect():
        got[r.doc_id].append((r.section, r.n_tokens, r.n_crossing))
    for i, t in enumerate(lines):
        parts = [p for p in (t or "").split("\n")]
        parts = [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])
        assert [x[1:] for x in sorted(got[i])] == (expected(parts) if parts else [(0, 0)]), i
    rows = [(1, "a b", "cé", None), (2, None, None, None), (2, None, None, None), (3, "x" * 5000, "", "y z")]
    fields = spark.createDataFrame(rows, "doc_id long, title string, body string, field string")
    names = ["title", "body", "field"]
    found = collections.Counter((r.doc_id, r.field, r.n_tokens, r.n_crossing) for r in token_spans.field_tokens(fields, make_tokens, names).collect())
    want = collections.Counter()
    for i, *values in rows:
        parts = [(v or "") + ("\n" if k < 2 else "") for k, v in enumerate(values)]
        want.update((i, n, *x) for n, x in zip(names, expected(parts)))
    assert found == want
    assert token_spans.section_tokens(make(spark, lines).limit(0), make_tokens).count() == 0 and token_spans.field_tokens(fields.limit(0), make_tokens, names).count() == 0


def test_fingerprints_by_plain_integers(texts):
    """Both fingerprints bit by bit, without numpy."""
    import math

    import xxhash

    whole = (1 << 64) - 1

    def mixed(h):
        h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & whole
        return h ^ (h >> 29)

    for t in texts[:12] + texts[-7:]:
        ws = [w for w in "".join(c.lower() if c.isascii() else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        runs = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] or ([" ".join(ws)] if ws else [])
        hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        assert near_dedup.simhash(near_dedup.shingle_hashes(t, 4)) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        one = [xxhash.xxh64_intdigest(w.encode(), 7) for w in ws]
        two = [mixed((a * 0x9E3779B97F4A7C15 + b) & whole) for a, b in zip(one, one[1:])]
        three = [mixed((a * 0x94D049BB133111EB + b) & whole) for a, b in zip(two, one[2:])]
        votes, total = [0] * 256, 0
        for terms, run in zip((one, two, three), fingerprint.RUN_WEIGHTS):
            for h, n in collections.Counter(terms).items():
                weight = round(1024 * run * (1 + math.log(n)))
                total += weight
                full = b"".join(mixed((h * m + 0xD6E8FEB86659FD93) & whole).to_bytes(8, "little") for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
                for b in range(256):
                    votes[b] += weight * (full[b // 8] >> (7 - b % 8) & 1)
        bits = "".join("1" if 2 * v > total else "0" for v in votes)
        assert fingerprint.fingerprint(t or "", fingerprint.WordHashes()).hex() == f"{int(bits, 2):064x}"


def test_near_copies_recall(spark):
    """Links of all pairs that share a shingle, against brute force: recall of 0.9 at least."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    sets = [(r.doc_id, set(near_dedup.shingle_hashes(r.text, 5).tolist())) for r in rows]
    by = collections.defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for h in s:
            by[h].add(k)
    pairs = {(a, b) for ks in by.values() if len(ks) < 200 for a in ks for b in ks if a < b}
    links = [(a, b) for a, b in pairs if len(sets[a][1] & sets[b][1]) >= 0.8 * len(sets[a][1] | sets[b][1])]
    groups = {r.node: r.component for r in near_dedup.near_groups(spark.createDataFrame(rows)).collect()}
    found = sum(groups.get(sets[a][0], -1) == groups.get(sets[b][0], -2) for a, b in links)
    assert len(links) > 50 and found >= 0.9 * len(links), (found, len(links))


@pytest.mark.parametrize("families", [1, 4, 40])
def test_hot_shards_lose_no_link(spark, families):
    """Shards far over the cap: one family about its lead, several, and rows that are mostly alone."""
    rng = np.random.default_rng(families)
    k = rng.integers(0, 2**63, families, dtype=np.uint64)[rng.integers(0, families, 150)]
    for _ in range(4):
        k = k ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    k = np.unique(k)
    keys = [int(x) if x < 2**63 else int(x) - 2**64 for x in k]
    shards = spark.createDataFrame([(t, 9, i, 1) for t in (0, 1) for i in range(len(keys)) if t == 0 or i < 3], "t int, key long, id long, bytes long")
    of = spark.createDataFrame(list(enumerate(keys)), "id long, fp long")
    want = brute_components([int(x) for x in k], 4)
    got = {r.node: r.component for r in components.connected_components(near_dedup._links(shards, 7, 4, ["id", "fp"], lambda rows: rows.join(of, "id"))).collect()}
    assert [got.get(i, i) for i in range(len(keys))] == want


def test_near_groups_of_a_hot_family(spark):
    """A large family, null ids and a cap far below its size: the groups are those of one tree."""
    rng = random.Random(8)
    base = words(rng, 150).split()
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [words(rng, 80) for _ in range(10)])] + [(None, texts[0])] * 9, "doc_id long, text string")
    groups = [sorted(tuple(r) for r in near_dedup.near_groups(docs, shard_cap=cap).collect()) for cap in (6, 32_768)]
    assert groups[0] == groups[1] and len(groups[0]) > 30
    assert near_dedup.drop_near(docs, shard_cap=6).where("doc_id IS NULL").count() == 9


def test_file_order_with_clashing_names(spark, tmp_path):
    import corpus_pipeline

    path = str(tmp_path / "docs")
    spark.range(50).selectExpr("id AS doc_id", "'x' AS text", "1 AS _file", "2 AS _name", "3 AS _row", "4 AS row", "5 AS `a.b`", "6 AS _metadata").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    got = corpus_pipeline.in_file_order(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == list(range(50))
