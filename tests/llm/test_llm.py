"""Operators on small tables, against brute force, the libraries or exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leafmill.llm import bpe, exact_dedup, language, media, mixing, near_dups, parity, substring_dedup, token_counts, toxicity, warc
from leafmill.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, digest string, id int"
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"])[i % len(sources or [1])], "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return docs(spark, ["x"]).limit(0)


def odd(spark):
    """Nulls in every column, empty texts, repeated rows, one long text."""
    long_ = " ".join(random.Random(1).choices(WORDS, k=30_000))
    rows = [(0, "a b c", "en", "s", None, None), (0, "a b c", "en", "s", None, None), (None, "a b c", None, None, None, None), (2, None, None, None, None, None), (3, "", "en", "", "x", 1), (4, "  \n ", "en", "s", "x", 1), (5, long_, "en", "s", "x", 1), (6, "é ß 日本 🙂", "de", "t", "x", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_exact_dedup(spark):
    d = docs(spark, ["a", "b", "a", "", None, "a ", "b"])
    for keep, best in (("max", max), ("min", min)):
        got = {r.id: r for r in exact_dedup.exact_dedup(d, keep=keep, runs=5, fanout=2).collect()}
        groups = defaultdict(list)
        for r in d.collect():
            groups[r.text or ""].append(r.doc_id)
        for text, ids in groups.items():
            for i in ids:
                assert (got[i].keep_id, got[i].group_size, got[i].kept) == (best(ids), len(ids), i == best(ids))
                assert got[i].text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    o = [(r.id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(odd(spark)).collect()]
    assert len(o) == 8 and (None, 0, False) in o and o.count((0, 0, True)) == 2


def fill(sizes, most=3):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        w = sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * left / w >= most * sizes[s]]
        if not full:
            target |= {s: weight[s] * left / w for s in free}
            break
        for s in full:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in full)
        free -= set(full)
    return target


def test_mixing(spark):
    rnd = random.Random(3)
    texts = [" ".join(WORDS[: rnd.randint(0, 30)]) for _ in range(300)]
    names = ["a"] * 12 + ["b", "c", "d", None]
    d = docs(spark, texts, names)
    got = mixing.mix(d).collect()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    want = fill(sizes)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert [r.position for r in got] == sorted(r.position for r in got) and all(0 <= r.position <= 1 for r in got)
    assert got == mixing.mix(d.repartition(7)).collect()
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix(odd(spark)).count() == 8


def test_positions_follow_the_schedule(spark):
    """Of a source that fades out, most documents are due early."""
    d = docs(spark, ["x y z"] * 400)
    at = sorted(r.position for r in mixing.mix(d, schedules=[[2.0, 0.0]]).collect())
    for i in range(0, 400, 40):
        t = at[i]
        assert 2 * t - t * t == pytest.approx(i / 400, abs=1e-6)


def shingles_of(t, width):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def near_brute(rows, width, p, q):
    sets = {i: shingles_of(t, width) for i, t in rows}
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and q * len(x & y) >= p * len(x | y):
                ca, cb = comp[a], comp[b]
                for k in comp:
                    if comp[k] in (ca, cb):
                        comp[k] = min(ca, cb)
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("width, p, q", [(3, 9, 10), (5, 8, 10)])
def test_near_dups(spark, width, p, q):
    rnd = random.Random(width)
    texts = []
    for size in (3, 9, 12, 40, 120, 300):
        base = rnd.choices(WORDS, k=size)
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            t = list(base)
            for _ in range(edits):
                t[rnd.randrange(len(t))] = rnd.choice(WORDS).upper()
            texts.append(" ".join(t))
    shared = rnd.choices(WORDS, k=60)
    texts += [" ".join(shared + rnd.choices(WORDS, k=k)) for k in range(1, 30)]  # a passage that many share
    chain = rnd.choices(WORDS, k=100)
    for _ in range(25):
        chain = chain[2:] + rnd.choices(WORDS, k=2)
        texts.append(" ".join(chain))
    texts += ["", None, "a", "A", "a b", " \t\n"]
    d = docs(spark, texts)
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dups.jaccard_components(d, width=width, p=p, q=q).collect()}
    assert got == near_brute(list(enumerate(texts)), width, p, q)


def same_components(rows, width, p, q):
    """Components of rows, repeated and null identifiers among them, by comparing all pairs."""
    sets = [shingles_of(t, width) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and q * len(a & b) >= p * len(a | b):
                x, y = comp[i], comp[j]
                comp = [y if c == x else c for c in comp]
    names = {}
    for c, (i, _) in zip(comp, rows, strict=True):
        if i is not None:
            names[c] = min(i, names.get(c, i))
    return Counter((i, len(s), names.get(c) if s else i) for c, s, (i, _) in zip(comp, sets, rows, strict=True))


@pytest.mark.parametrize(("width", "p", "q"), [(3, 9, 10), (5, 8, 10)])
def test_near_dups_of_a_large_cluster(spark, width, p, q):
    """Copies on both sides of the threshold, long sets, identifiers that are null or repeat, a passage in all."""
    rnd = random.Random(width + q)
    texts = []
    for base in (rnd.choices(WORDS, k=150), rnd.choices(WORDS, k=420)):
        for _ in range(120):
            t = list(base)
            for _ in range(rnd.randrange(0, len(base) // 12)):
                t[rnd.randrange(len(t))] = rnd.choice(WORDS) + rnd.choice("xy")
            texts.append(" ".join(t))
    passage = " ".join(rnd.choices(WORDS, k=60))
    texts += [passage + " " + " ".join(rnd.choices(WORDS, k=rnd.randrange(5, 90))) for _ in range(120)]
    ids = [None if k % 17 == 3 else k // 2 if k % 5 == 0 else 1000 + k for k in range(len(texts))]
    d = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = near_dups.jaccard_components(d, width=width, p=p, q=q).collect()
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == same_components(list(zip(ids, texts, strict=True)), width, p, q)


def test_near_dups_rows_that_stand(spark):
    """One row of each component is the first; identifiers that repeat and null ones lose no links."""
    t = [" ".join(random.Random(k).choices(WORDS, k=60)) for k in range(3)]
    rows = [(1, t[0]), (1, t[1]), (2, t[1] + " end"), (None, t[0] + " end"), (None, t[2]), (3, ""), (4, None), (5, "one"), (6, "ONE")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dups.jaccard_components(d).collect()
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == same_components(rows, 5, 8, 10)
    assert sum(r.first for r in got) == 6  # one each of 1 and null, 1 and 2, null alone, 3, 4, and 5 and 6


def test_pairs_of_a_cluster_stay_linear(spark):
    """Copies with edits of their own, each too far from the others: next to no pairs are made."""
    rnd = random.Random(8)
    base = rnd.choices(WORDS, k=150)
    texts = []
    for k in range(500):
        t = list(base)
        for at in rnd.sample(range(150), 4 + k % 9):
            t[at] = f"new{rnd.random()}"
        texts.append(" ".join(t))
    seen = []
    real = near_dups.cluster_pairs
    near_dups.cluster_pairs = lambda *a, **b: seen.append(x := near_dups.cut(real(*a, **b))) or x
    try:
        near_dups.jaccard_components(docs(spark, texts), width=3, p=9, q=10).count()
    finally:
        near_dups.cluster_pairs = real
    assert len(seen) == 1 and seen[0].count() < 500  # of 125,000


def test_near_dups_odd(spark):
    assert near_dups.jaccard_components(empty(spark)).count() == 0
    got = {r.id: r.component_id for r in near_dups.jaccard_components(odd(spark)).collect()}
    assert got[None] == 0 and got[0] == 0 and got[2] == 2


def test_sketches_bound_the_difference():
    rnd = random.Random(5)
    shingles = parity.Shingler(3)
    for n in (20, 200, 2000):
        a = rnd.choices(WORDS, k=n)
        b = list(a)
        for _ in range(n // 50):
            b[rnd.randrange(n)] = "new"
        x, y = shingles(" ".join(a).encode()), shingles(" ".join(b + a[:9]).encode())
        differ = len(set(x.tolist()) ^ set(y.tolist()))
        assert parity.hamming(parity.sketch(x), parity.sketch(y)) <= differ
        bands = parity.Bands(9, 10)
        if differ <= bands.differ(len(x) + len(y)) and n >= 200:
            for (a_keys, a_spare), (b_keys, b_spare) in zip(bands.keys(x), bands.keys(y), strict=False):
                same = set(a_keys.tolist()) & set(b_keys.tolist())
                assert len(same) > min(a_spare, b_spare)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (103, 101)], "a long, b long")
    got = {r.node: r.comp for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == got[101] == 100


def test_warc(spark):
    rows = [(1, "http://a b/ü", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 70_000), (None, None, "<p>x</p>"), (6, "\nx", "\r\n\r\nContent-Length: 5")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.archive_pages(p)
    got = {r.page_id: r for r in warc.read_archives(index, payloads=True).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[2].record_type == "response" and got[None].refers_to == 2
    assert got[3].refers_to == 4 and got[5].payload_bytes == 140_000 and bytes(got[5].payload).decode() == "é" * 70_000
    assert all(got[i].payload_digest == warc.digest32((t or "").encode()) for i, _, t in rows)
    assert {r.page_id: r.record_type for r in warc.read_archives(warc.archive_pages(p, least=100)).collect()}[1] == "response"
    assert warc.archive_pages(p.limit(0)).count() == 0


@pytest.mark.parametrize("spoil", [lambda b: b[:-1], lambda b: b.replace(b"WARC/1.1", b"WARC/9.9"), lambda b: b.replace(b"WARC-Date", b"X-Date"), lambda b: b.replace(b"body", b"bodx"), lambda b: b.replace(b"Content-Length: 4", b"Content-Length: 5")])
def test_bad_records_are_refused(spoil):
    good = warc.record_bytes(1, "u", b"body", None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(good)["payload"] == b"body"
    with pytest.raises(ValueError):
        warc.parse_record(spoil(good))


def test_frames_need_their_dictionary(tmp_path):
    import io
    import struct

    import zstandard

    words = warc.make_dictionary([f"record {i} of the archive".encode() * 3 for i in range(300)])
    c = zstandard.ZstdCompressor(dict_data=words)
    front = words.as_bytes()
    for body in (front, zstandard.ZstdCompressor().compress(front)):
        data = struct.pack("<II", warc.DICTIONARY_MAGIC, len(body)) + body + c.compress(b"one") + c.compress(b"two" * 99)
        assert list(warc.frames(io.BytesIO(data), step=7)) == [b"one", b"two" * 99]
        with pytest.raises(ValueError):
            list(warc.frames(io.BytesIO(data[:-3])))


def test_media(spark):
    d = odd(spark).unionByName(docs(spark, ["x" * 64, "x" * 65]))
    index = media.store(d, shard_bytes=4096)
    meta = {(r.digest, r.height) for r in media.fill_metadata(index).collect()}
    full = media.fill_features(index).collect()
    assert len(full) == 10 and index.select("shard").distinct().count() > 1
    want = Counter()
    for r in d.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[(r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))] += 1
    assert Counter((r.id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in full) == want
    assert {(r.digest, r.payload_bytes // 64) for r in full} == meta and all(r.digest == r.payload_sha256 for r in full)
    assert media.fill_features(media.store(empty(spark))).count() == 0


TRICKY = ["", "a  b", "  x", "x  ", "a \n \n b", "\n\n x\t\t y", "don't I'll  'S", "日本語 é 🙂🙂 a😀", "<|endoftext|> x<|endoftext|>", " " * 50 + "b", "a" * 3000, "12 345,6.7", " x  y", "x\r\n y"]


def test_bpe_equals_the_library(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    d = docs(spark, TRICKY).unionByName(odd(spark))
    got = bpe.encode_documents(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ids=True).collect()
    texts = [((r.text or ""), r.doc_id) for r in d.select("text", "doc_id").collect()]
    assert len(got) == len(texts)
    by = defaultdict(list)
    for r in got:
        by[r.id].append(r)
    for text, i in texts:
        ids = library.encode_ordinary(text)
        assert any(r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() for r in by[i])
    assert bpe.encode_documents(empty(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_perfect_hash():
    ids = {f"k{i}".encode(): i for i in range(1000)}
    h = bpe.PerfectHash(ids)
    assert len(h.keys) == 1000 and all(h.get(k) == v for k, v in ids.items()) and h.get(b"other") == -1
    assert bpe.PerfectHash({}).get(b"") == -1


def test_token_counts_equal_the_library(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    d = docs(spark, TRICKY).unionByName(odd(spark))
    got = Counter((r.id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(d, P.path("byte_bpe_50k.json"), block_bytes=200).collect())
    assert got == Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in d.collect())
    assert token_counts.token_counts(empty(spark), P.path("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        token_counts.read_spec(P.path("word_bpe_49k.json"))


def test_language(spark):
    rnd = random.Random(2)
    parts = {"en": ["the", "ing", "tion", "er"], "de": ["sch", "ung", "ß", "ei"], "fr": ["eau", "ç", "oi", "que"]}
    rows = [(i, " ".join("".join(rnd.choices(parts[l], k=rnd.randint(1, 3))) for _ in range(30)), l) for i in range(240) for l in [list(parts)[i % 3]]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(d.where("doc_id < 180"))
    got = {r.id: r for r in language.predict(d, model).collect()}
    assert sum(got[i].lang_pred == l for i, _, l in rows if i >= 180) == 60
    assert all(0 <= r.score <= 1 for r in got.values())
    o = {r.id: r.lang_pred for r in language.predict(odd(spark), model).collect()}
    assert o[2] == o[3] == o[4] == "und" and o[6] != "und"
    nothing = language.fit(d.limit(0))
    assert {r.lang_pred for r in language.predict(d.limit(3), nothing).collect()} == {"und"} and language.predict(d.limit(0), model).count() == 0


def test_toxicity(spark):
    rnd = random.Random(4)
    texts, labels = [], []
    for i in range(300):
        s = [" ".join(rnd.choices(WORDS, k=8)) for _ in range(rnd.randint(1, 12))]
        if i % 4 == 0:
            s[rnd.randrange(len(s))] += " " + rnd.choice(["foul", "vile"]) + " w1"
        texts.append(". ".join(s) + ".")
        labels.append(int(i % 4 == 0))
    d = docs(spark, texts)
    l = spark.createDataFrame([(i, y) for i, y in enumerate(labels) if i % 5], "doc_id long, toxic int").union(spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(d, l)
    got = {r.id: r for r in toxicity.score(d, model).collect()}
    assert all((got[i].score >= 0.5) == bool(labels[i]) for i in range(0, 300, 5))
    for i in range(0, 300, 20):
        found = [texts[i][s.start : s.end] for s in got[i].sentences]
        assert len(found) == 1 and ("foul" in found[0] or "vile" in found[0])
    o = toxicity.score(odd(spark), model).collect()
    assert len(o) == 8 and all(0 <= r.score <= 1 for r in o) and {r.score for r in o if r.id in (2, 3)} == {0.0}
    assert toxicity.score(empty(spark), model).count() == 0
    assert toxicity.fit(d, l.limit(0)).weights == {}


def test_substring_dedup(spark):
    passage = "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen."
    texts = [f"{passage}\nown words of the first document here", f"Before it stands something of its own here. {passage} And after.\nshort line", f"{passage}\n{passage}", "short line", None, ""]
    d = docs(spark, texts)
    got = {r.id: r for r in substring_dedup.dedup_units(d).collect()}
    assert got[0].n_removed == 0 and got[0].clean_text == texts[0]
    assert "Eight nine" not in got[1].clean_text and got[1].clean_text.startswith("Before it") and got[1].clean_text.endswith("And after.\nshort line")
    assert got[2].clean_text == "" and got[3].clean_text == "short line" and got[4].clean_text == ""
    for i, t in enumerate(texts):
        assert "".join((t or "")[s.start : s.end] for s in got[i].kept) == got[i].clean_text
        assert sum(s.end - s.start for s in got[i].removed) == got[i].removed_chars
    assert substring_dedup.dedup_units(empty(spark)).count() == 0 and substring_dedup.dedup_units(odd(spark)).count() == 8


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rnd = random.Random(9)
    base = [" ".join(rnd.choices(WORDS, k=60)) for _ in range(60)]
    texts = base + base[:5] + [base[10] + " more"] + [f"{b}. A foul thing." for b in base]
    d = docs(spark, texts, ["a", "b"])
    spark.createDataFrame([(i, int("foul" in t)) for i, t in enumerate(texts)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(cp.STAGES)
    clean = stages["toxicity"](spark, d, str(tmp_path))
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == set(range(66))
    once = stages["exact_dedup"](spark, clean, "")
    assert {r.doc_id for r in once.collect()} == set(range(66)) - set(range(5))
    one = stages["near_dups"](spark, once, "")
    assert {r.doc_id for r in one.collect()} == set(range(66)) - set(range(5)) - {65}
    mixed = stages["mixing"](spark, one, "")
    plan = {r.id: r.copies for r in mixing.mix(one).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in plan.items() if n})
    out = cp.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed.collect())
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out)


def test_samples_by_hash_only(spark):
    """The held-out rows are the ones the checksum says."""
    d = spark.range(50).select(F.col("id").alias("doc_id")).withColumn("h", toxicity.held_out("doc_id", 5, 0))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in d.collect())


@pytest.mark.parametrize("pattern", [r"\p{L}+|\d| ", r"\S+|\s", r"[a-z]+"])
def test_bpe_of_other_patterns(spark, pattern):
    """Chunks are this pattern's own pre-tokens; what it passes over is no token."""
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = [t for t in TRICKY if len(t) < 1000] + ["plain words, and more words 42", "ABC", None]
    got = {r.id: r.ids for r in bpe.encode_documents(docs(spark, texts), path, pattern, ids=True).collect()}
    assert got == {k: library.encode_ordinary(t or "") for k, t in enumerate(texts)}


@pytest.mark.parametrize(("width", "p", "q"), [(2, 1, 2), (1, 19, 20)])
def test_near_dups_at_other_thresholds(spark, width, p, q):
    rnd = random.Random(p * q)
    texts = []
    for size in (4, 20, 90):
        base = rnd.choices(WORDS, k=size)
        for edits in range(0, size // 2 + 1, max(1, size // 12)):
            t = list(base)
            for at in rnd.sample(range(size), edits):
                t[at] = rnd.choice(WORDS).upper() + "x"
            texts.append(" ".join(t))
    got = near_dups.jaccard_components(docs(spark, texts), width=width, p=p, q=q).collect()
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == same_components(list(enumerate(texts)), width, p, q)
