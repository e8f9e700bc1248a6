"""Token records, conversation repair and centroid clustering against plain versions."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from leafmill.llm import centroids, conversations, token_records
from leafmill.llm.boundaries import Boundaries

TEXT = "doc_id long, text string, Text2 string, n int, h string, id string"


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def plain_checksum(data):
    r = 0xFFFFFFFF
    for x in data:
        r ^= x
        for _ in range(8):
            r = (r >> 1) ^ (0x82F63B78 if r & 1 else 0)
    r ^= 0xFFFFFFFF
    return ((r >> 15 | r << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksums():
    rnd = random.Random(1)
    parts = [rnd.randbytes(n) for n in (4, 5, 8, 511, 512, 513, 1024, 1500, 4000)] + [b"123456789"]
    got = token_records.Crc32c().masked(parts)
    assert got == [plain_checksum(p) for p in parts]
    r = 0xE3069283  # the published check value
    assert got[-1] == ((r >> 15 | r << 17) + 0xA282EAD8) & 0xFFFFFFFF
    assert token_records.Crc32c().masked([]) == []


def test_frames_that_are_damaged():
    (frame,) = token_records.frames([b"some payload"])
    assert [bytes(p) for p in token_records.payloads_of([frame])] == [b"some payload"]
    for k in range(len(frame)):
        bad = bytearray(frame)
        bad[k] ^= 4
        with pytest.raises(ValueError):
            token_records.payloads_of([bytes(bad)])
    for short in (frame[:-1], frame[:10], b""):
        with pytest.raises(ValueError):
            token_records.payloads_of([short])


ODD = ["a", "b", "É", "日", "本", "1", "²", "Ⅷ", " ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", "　", "​", "'s", "'", "'re", "'ll", "'d's", "''s", ".", ",", "<|endoftext|>", "<|end", "🙂", "é", "_", "\x00", "\U0010ffff"]


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(ODD, k=rnd.randint(0, 14))) for _ in range(n)] + ["", " ", "'", "'s", "s'"]


def test_encoding_equals_the_library():
    from leafmill.llm.token_counts import read_spec

    texts, tok = odd_texts(3000), library()
    for together in (1, 3, 512):
        codec = token_records.LibraryCodec(*read_spec(tokenizer_path()), together=together)
        for at in (0, 1000):  # some of it is remembered by then
            ids, ends = codec.encode([t.encode() for t in texts[at:]])
            for t, a, b in zip(texts[at:], ends[:-1], ends[1:], strict=True):
                assert ids[a:b].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_boundaries_equal_the_pattern():
    import regex

    from leafmill.llm.token_counts import BYTE_LEVEL

    find = regex.compile(BYTE_LEVEL)
    texts = [t for t in odd_texts(3000, 2) if t]
    raws = [t.encode() for t in texts]
    begins = np.cumsum([0, *map(len, raws)])
    want = [b + len(t[: m.start()].encode()) for b, t in zip(begins[:-1].tolist(), texts, strict=True) for m in find.finditer(t)]
    assert Boundaries().pieces(np.frombuffer(b"".join(raws), np.uint8), begins[:-1]).tolist() == want


def test_token_records(spark):
    rnd, tok = random.Random(5), library()
    texts = odd_texts(150, 3) + [None, " ".join(f"w{rnd.randint(0, 500)}" for _ in range(200_000))]
    rows = [(i * 7 % 1000 if i % 9 else None, t, "x", 1, "h", "id") for i, t in enumerate(texts)]
    rows += [(3, "of one identifier", None, None, None, None)] * 60 + [(3, "another text", None, None, None, None)]  # a third of all rows
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, TEXT)
    manifest = token_records.write_records(docs, tokenizer_path(), end_id=2, file_bytes=4000)
    got = token_records.read_files(manifest).collect()
    want = Counter((k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in ((r[0], [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows))
    assert Counter((r.id, r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(itertools.accumulate((r.n_tokens for r in ordered[:-1]), initial=0))
    keys = [-1 if r.id is None else r.id for r in ordered]
    assert keys == sorted(keys)
    assert manifest.count() > 4
    shuffled = token_records.read_shuffled(manifest, seed=4).collect()
    assert Counter((r.id, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in shuffled) == want
    assert [r.id for r in shuffled] == [r.id for r in token_records.read_shuffled(manifest, seed=4).collect()] != [r.id for r in token_records.read_shuffled(manifest, seed=5).collect()]
    none = token_records.write_records(docs.limit(0), tokenizer_path(), end_id=2)
    assert none.count() == 0 and token_records.read_files(none).count() == 0 and token_records.read_shuffled(none, 1).count() == 0


def plain_repair(rows):
    """Every edit sequence of least cost, by brute force over (row, state), and the least audit."""
    best = {"": (0, "", [])}  # by the initials of the role pattern reached: "", s, u, a
    follows = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    wanted = {"": "u", "s": "u", "u": "a", "a": "u"}
    role_of = {"u": "user", "a": "assistant"}

    def inserts(paths):
        out = {}
        for state, (cost, audit, lines) in paths.items():
            now = (cost, audit, lines)
            for _ in range(5):
                if state not in out or now[:2] < out[state][:2]:
                    out[state] = now
                r = wanted[state]
                now = (now[0] + 5, now[1] + "I", [*now[2], f"{role_of[r]}:"])
                state = r
        return out

    for (role, text), fault in rows:
        after = {}

        def offer(state, value, after=after):
            if state not in after or value[:2] < after[state][:2]:
                after[state] = value

        for state, (cost, audit, lines) in inserts(best).items():
            offer(state, (cost + 2, audit + "D", lines))
            if fault not in ("b", "d"):
                more = 5 if fault == "t" else 0
                if (state, role[:1]) in follows:
                    offer(role[:1], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                r = wanted[state]
                offer(r, (cost + more + 1, audit + "R", [*lines, f"{role_of[r]}:{text}"]))
        best = after
    ends = inserts(best)
    cost, audit, lines = min((ends[s] for s in ("", "a") if s in ends), key=lambda x: x[:2])
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain_conversations(rows):
    """What is said of each conversation, from damaged rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        hurt = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            name = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            role, text, hit = " " if role is None else role, " " if text is None else text, zlib.crc32(name.encode()) % 20
            if hit == 1:
                text = ""
            if hit == 2:
                text = text.replace(".", "").replace("!", "").replace("?", "")
            if hit == 4:
                role = "user"
            hurt += [(turn, role, text)] * {0: 0, 3: 2}.get(hit, 1)
        hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, told = set(), []
        for _, role, text in hurt:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            told.append(((role, text), "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = {t for t, _, _ in hurt if t is not None}
        kinds, initials = [k for _, k in told], [r[:1] for _, r, _ in hurt]
        bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("b"), kinds.count("d"), kinds.count("t"), bad, *plain_repair(told))
    return out


def conversation_rows(n, longest, seed):
    rnd = random.Random(seed)
    texts = ["Yes.", "no", "", " \n", "Why? ", "é ß 日本", None, "a.b", "Sure!", "Done "]
    rows = []
    for c in [None, *range(n)]:
        for t in range(rnd.randint(0, longest)):
            rows.append((c, rnd.choice([t, t, t, t + 3, None, 0]), rnd.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool", "ärger"]), rnd.choice(texts) if rnd.random() < 0.5 else f"text {rnd.randint(0, 40)}."))
    rnd.shuffle(rows)
    return rows


SAID = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("n", "longest", "most_rows", "seed"), [(120, 9, 2000, 1), (6, 60, 3, 2), (1, 400, 7, 3)])
def test_conversations(spark, n, longest, most_rows, seed):
    rows = conversation_rows(n, longest, seed)
    damaged = conversations.damaged(spark.createDataFrame(rows, SAID))
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair_conversations(damaged, most_rows=most_rows).collect()}
    assert got == plain_conversations(rows)


def test_a_conversation_of_a_third_of_all_rows(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(3000)] + [(1, None, "user", "Again.")] * 500 + conversation_rows(800, 8, 7)
    found = conversations.repair_conversations(conversations.damaged(spark.createDataFrame(rows, SAID)), most_rows=100)
    assert {r.conv_id: tuple(r)[1:] for r in found.collect()} == plain_conversations(rows)


def test_conversations_none_and_extra_columns(spark):
    none = spark.createDataFrame([], SAID)
    assert conversations.repair_conversations(conversations.damaged(none)).count() == 0
    rows = [(1, 0, "user", "A."), (1, 1, "assistant", "x" * 3_000_000 + "."), (2, 0, "user", "B.")]
    more = spark.createDataFrame([(*r, 7, "z", "y") for r in rows], SAID + ", hit int, gone string, h string")
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair_conversations(conversations.damaged(more)).collect()}
    assert got == plain_conversations(rows)


def test_every_row_dropped(spark):
    dropped = next((c, t) for c in range(1000) for t in range(5) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    ((c, *rest),) = conversations.repair_conversations(conversations.damaged(spark.createDataFrame([(*dropped, "user", "A.")], SAID))).collect()
    assert c == dropped[0] and rest == [0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]


def plain_lloyd(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], "<i4").tobytes()))[:k]
    cents = [list(v) for _, v in seeds]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, vs in groups.items():
            cents[n] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    told = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in told:
        inertia[n] += d
    return Counter((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, d, n in told)


def test_centroids(spark):
    rnd = random.Random(4)
    base = [[rnd.uniform(-1, 1) for _ in range(64)] for _ in range(60)]
    rows = [(i, base[0] if i % 3 == 0 else [x + rnd.uniform(-0.1, 0.1) for x in rnd.choice(base)]) for i in range(400)]  # one vector in a third of all rows
    rows += [(1000, None), (1001, []), (1002, [0.5] * 63), (1003, [float("nan")] + [0.0] * 63), (1004, [None] + [0.0] * 63), (1005, [float("inf")] * 64), (None, base[1]), (7, base[2]), (7, base[2])]
    schema = "vec_id long, embedding array<float>, vec int, part string, cluster int"
    d = spark.createDataFrame([(i, v, 1, "p", 2) for i, v in rows], schema)
    floats = [(r.vec_id, r.embedding) for r in d.collect()]
    assert Counter(tuple(r) for r in centroids.weighted_lloyd(d).collect()) == plain_lloyd(floats)
    few = d.where("vec_id < 5 OR vec_id >= 1000")
    assert Counter(tuple(r) for r in centroids.weighted_lloyd(few).collect()) == plain_lloyd([(i, v) for i, v in floats if i is not None and (i < 5 or i >= 1000)])
    assert centroids.weighted_lloyd(d.limit(0)).count() == 0
    assert centroids.weighted_lloyd(d.where("vec_id >= 1000")).count() == 0


def test_centroids_of_large_components(spark):
    d = spark.createDataFrame([(i, [float(x * (i + 1)) for x in range(64)]) for i in range(30)] + [(50, [-2e6] * 64), (51, [2e6] * 64)], "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in d.collect()]
    assert Counter(tuple(r) for r in centroids.weighted_lloyd(d).collect()) == plain_lloyd(rows)
    with pytest.raises(Exception, match="too large"):
        centroids.weighted_lloyd(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).collect()
