import hashlib
import itertools
import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import common, exact, lm, minhash, mixing, substring
from tessera.llm.graph import connected_components
from tests.llm.helpers import documents, frame, lower, words


def test_exact_groups_match_brute_force(spark):
    groups = defaultdict(list)
    for r in documents():
        groups[lower(r[1])].append(r[0])
    got = exact.exact_groups(frame(spark)).collect()
    expected = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        expected.update((i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_tells_colliding_hashes_apart(spark):
    weak = lambda text: F.unhex(F.substring(F.md5(text), 1, 2))
    order = lambda rows: sorted(map(repr, rows))
    docs = frame(spark)
    assert order(exact.exact_groups(docs, weak).collect()) == order(exact.exact_groups(docs).collect())
    assert order(exact.drop_exact_copies(docs, weak).collect()) == order(exact.drop_exact_copies(docs).collect())


def test_drop_exact_copies(spark):
    docs = frame(spark)
    got = exact.drop_exact_copies(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == len({lower(r[1]) for r in documents()}) == len({lower(r.text) for r in rows})
    assert exact.drop_exact_copies(docs.limit(0)).count() == exact.exact_groups(docs.limit(0)).count() == 0


def shingle_sets(rows, width):
    for doc_id, text, *_ in rows:
        ws = words(lower(text))
        yield doc_id, {tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set()


def brute_components(rows, width, percent=80):
    sets = [(i, s) for i, s in shingle_sets(rows, width)]
    parent = {i: i for i, _ in sets if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return Counter((i, len(s), find(i) if i is not None else None) for i, s in sets)


def test_near_groups_match_brute_force(spark):
    for width in (2, 5):
        got = minhash.near_groups(frame(spark), width).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(documents(), width)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_groups_of_many_variants(spark):
    """Variants of one text at similarities on both sides of the threshold: links that no star centre has."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(80):
        own = list(base)
        for at in rng.choice(60, rng.integers(1, 7), replace=False):
            own[at] = f"v{rng.integers(5)}"
        rows.append((k, " ".join(own), *[None] * 7))
    got = minhash.near_groups(frame(spark, rows), 2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 2)


def test_drop_near_copies(spark):
    docs = frame(spark)
    got = minhash.drop_near_copies(docs, 2)
    assert got.columns == docs.columns
    dropped = sum(n for (i, _, c), n in brute_components(documents(), 2).items() if i != c)
    assert got.count() == len(documents()) - dropped
    assert minhash.drop_near_copies(docs.limit(0)).count() == 0


def test_estimate_is_corrected_for_collisions():
    rng = np.random.default_rng(0)
    shared, rest = rng.integers(-(2**62), 2**62, 800), rng.integers(-(2**62), 2**62, 400)
    values = np.concatenate([shared, rest[:200], shared, rest[200:]])
    d1, d2, bands, bits = minhash.signatures(values, np.array([0, 1000]))
    planes = bits[0] ^ bits[1]
    differ = sum(bin(int(planes[k] | planes[minhash._LONGS + k])).count("1") for k in range(minhash._LONGS))
    estimate = 1 - differ / (minhash.HASHES * (1 - 2.0**-minhash.BITS))
    assert abs(estimate - 800 / 1200) < 0.15
    assert d1[0] != d1[1] and d2[0] != d2[1]


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 150: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mix_reaches_targets(spark):
    rows = documents()
    got = mixing.mix(frame(spark)).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    aims, taken, sizes = {}, Counter(), Counter()
    for r in got:
        aims[r.source] = (r.source_size, r.target)
        taken[r.source] += r.taken
        sizes[r.source] += r["size"]
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
    assert {s: a for s, (a, _) in aims.items()} == dict(sizes)
    assert math.isclose(sum(t for _, t in aims.values()), total)
    assert all(t <= 3 * s + 1e-9 for s, t in aims.values())
    longest = max(r["size"] for r in got)
    assert all(abs(taken[s] - aims[s][1]) <= longest for s in aims)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(frame(spark)).collect()))


def test_targets_share_what_exceeds_the_cap(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 10), (None, 500), ("d", 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    # b (weight 2) and c (weight 3) stop at 30; d has nothing; a (1) and null (2) share the rest 1:2, null within 1500.
    assert got["b"] == got["c"] == 30 and got["d"] == 0
    assert math.isclose(got["a"], 1460 / 3) and math.isclose(got[None], 2 * 1460 / 3)


def test_mixed_documents(spark):
    docs = frame(spark)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    assert sum(len(words(r.text)) for r in mixed.collect()) == want
    assert mixing.mix(docs.limit(0)).count() == mixing.mixed_documents(docs.limit(0)).count() == 0


def test_lm_scores_match_brute_force(spark):
    def grams(ws, k):
        return Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))

    rows = [(k, words(lower(r[1]))) for k, r in enumerate(documents())]
    docs = frame(spark, [(k, r[1], *[None] * 7) for k, r in enumerate(documents())])
    for order in (1, 2, 3):
        counts = [None, *[sum((grams(ws, k) for _, ws in rows), Counter()) for k in range(1, order + 1)]]
        total = sum(counts[1].values())
        got = {r.doc_id: r for r in lm.score(docs, order, block_words=700, table_grams=900).collect()}
        assert len(got) == len(rows)
        for doc_id, ws in rows:
            own, score, off = [None, *[grams(ws, k) for k in range(1, order + 1)]], 0.0, 0
            for at in range(len(ws)):
                other = lambda g: counts[len(g)][g] - own[len(g)][g]  # noqa: E731, B023
                factor, value, top = 1.0, None, min(order, at + 1)
                for k in range(top, 0, -1):
                    g = tuple(ws[at - k + 1 : at + 1])
                    if other(g) > 0:
                        value = factor * other(g) / (other(g[:-1]) if k > 1 else max(total - len(ws), 1))
                        off += k < top
                        break
                    factor *= lm.ALPHA
                else:
                    value, off = factor / max(total - len(ws), 1), off + 1
                score += math.log(value)
            r = got[doc_id]
            assert (r.n_words, r.n_backed_off) == (len(ws), off)
            assert r.score is None if not ws else math.isclose(r.score, score / len(ws), rel_tol=1e-9)


def test_lm_empty(spark):
    assert lm.score(frame(spark, [])).count() == 0
    assert [r.score for r in lm.score(frame(spark, [(1, None, *[None] * 7)])).collect()] == [None]


def random_text(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(n))


def test_repeated_passages_are_found_and_clean_texts_left_alone(spark):
    rng = np.random.default_rng(1)
    passage = random_text(rng, 55)
    rows = [(k, random_text(rng, 150), *[None] * 7) for k in range(30)]
    planted = {4: 20, 9: 77, 15: 3, 22: 140}
    for k, at in planted.items():
        ws = rows[k][1].split()
        rows[k] = (k, " ".join([*ws[:at], passage, *ws[at:]]), *rows[k][2:])
    rows += [(40, rows[0][1], *[None] * 7), (41, None, *[None] * 7), (42, "", *[None] * 7), (None, rows[0][1], *[None] * 7), rows[1]]
    found = substring.repeated_spans(frame(spark, rows)).collect()
    assert {r.doc_id for r in found} == {9, 15, 22, 40}
    assert all(r.first_doc_id == (0 if r.doc_id == 40 else 4) for r in found)
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        span = texts[r.doc_id].encode()[r.start : r.start + r.length].decode().strip()
        assert span in texts[r.first_doc_id]
    cut = {r.doc_id: r.text for r in substring.cut_repeats(frame(spark, rows)).collect()}
    assert not cut[40].strip() and set(cut) == {9, 15, 22, 40}
    assert substring.repeated_spans(frame(spark, [])).count() == 0


def test_chunks_cover_texts_and_resist_insertions():
    rng = np.random.default_rng(2)
    text = random_text(rng, 3000)
    ends = substring.chunk_ends(np.frombuffer(text.encode(), np.uint8))
    assert ends[-1] == len(text) and ends == sorted(set(ends))

    def pieces(t):
        cuts = substring.chunk_ends(np.frombuffer(t.encode(), np.uint8))
        return {t[a:b] for a, b in zip([0, *cuts], cuts, strict=False)}

    assert len(pieces(text) - pieces("inserted words " + text)) <= 4
    long_word = substring.chunk_ends(np.frombuffer(b"x" * 5000, np.uint8))
    assert max(np.diff([0, *long_word])) <= substring.MAX_BYTES


def test_repeats_without_white_space_and_across_it(spark):
    rng = np.random.default_rng(4)
    han = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9FA5, n)))
    text, other, a, b = han(3000), han(3000), random_text(rng, 15), random_text(rng, 15)
    rows = [(1, text), (2, "\u4e00\u4e8c" + text), (3, other), (4, han(200) + other[500:900] + han(200)), (5, "ab" * 4), (6, "  " * 4000), (7, " " * 9000)]
    rows += [(8, a + " " * 3000 + b), (9, random_text(rng, 20) + "\n" + a + " " * 3000 + b)]
    found = substring.repeated_spans(frame(spark, [(*r, *[None] * 7) for r in rows])).collect()
    texts = {k: t.encode() for k, t in rows}
    share = {k: sum(len(texts[k][r.start : r.start + r.length].decode().strip()) for r in found if r.doc_id == k) for k in texts}
    assert share[2] > 2900 and 300 < share[4] <= 400
    assert [r.doc_id for r in found if r.doc_id in (8, 9)] == [9] and share[9] > 3000
    assert {r.doc_id for r in found} == {2, 4, 9}


def test_gear_equals_the_rolling_definition():
    data = np.frombuffer(bytes(range(200)), np.uint8)
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(substring._GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    assert substring.gear(data).tolist() == out


def test_repeated_spans_match_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(500)]
    make = lambda n: " ".join(rng.choice(vocabulary, n))
    shared = [make(60) for _ in range(3)] + ["漢字" * 200]
    texts = [" ".join([make(rng.integers(0, 50)), shared[rng.integers(0, 4)], make(rng.integers(0, 50))]) for _ in range(60)] + [None, "", " \n ", shared[0], shared[0] + "\n" + shared[0]]
    rows = [(k, t, *[None] * 7) for k, t in enumerate(texts)] + [(None, shared[0], *[None] * 7), (5, texts[5], *[None] * 7)]
    white = b" \t\n\x0b\x0c\r"
    pieces = {}  # of each document: start, length, words that begin there, other bytes, digest
    for k, t in enumerate(texts):
        raw, at, found = (t or "").encode(), 0, []
        for end in substring.chunk_ends(np.frombuffer(raw, np.uint8)) if raw else []:
            solid = [x not in white for x in raw[at:end]]
            begun = sum(x and (at + i == 0 or raw[at + i - 1] in white) for i, x in enumerate(solid))
            if any(solid):
                found.append((at, end - at, begun, sum(solid), raw[at:end].strip(white)))
            at = end
        pieces[k] = found
    first = {}
    for k in pieces:
        for i, p in enumerate(pieces[k]):
            first.setdefault(p[4], (k, i))
    expected = Counter()
    for k, own in pieces.items():
        again = [i for i, p in enumerate(own) if first[p[4]] != (k, i)]
        for _, run in itertools.groupby(enumerate(again), lambda x: x[1] - x[0]):
            span = [own[i] for _, i in run]
            if sum(p[2] for p in span) >= substring.MIN_WORDS or sum(p[3] for p in span) >= substring.WORD_BYTES * substring.MIN_WORDS:
                expected[k, span[0][0], span[-1][0] + span[-1][1] - span[0][0], sum(p[2] for p in span), len(span)] += 1
    got = Counter((r.doc_id, r.start, r.length, r.n_words, r.n_chunks) for r in substring.repeated_spans(frame(spark, rows)).collect())
    assert got == expected and len(got) > 30


def test_keys_apart_and_bitmaps_change_no_result(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(3000)] + [(None, -1)] * 40, "key int, v int")
    table = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    for total in (10, rows.count(), 10**9):  # all keys hot, as counted, none hot
        for how in ("inner", "left"):
            got = common.join_counted(rows, table.filter("key is null or key != 2"), ["key"], "n", total, how).collect()
            assert Counter((r.key, r.v, r.top) for r in got) == Counter((r.key, r.v, r.top) for r in rows.join(table.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k"))).withColumn("top", F.when(F.coalesce(F.col("key") != 2, F.lit(True)), F.col("top"))).collect() if how == "left" or r.key != 2)
    gone = spark.createDataFrame([(k,) for k in range(0, 3000, 5)], "x long")
    left = common.without(rows, gone, "v")
    assert left.columns == rows.columns and sorted(r.v for r in left.collect()) == sorted([k for k in range(3000) if k % 5] + [-1] * 40)
    assert common.without(rows, gone.limit(0), "v").count() == rows.count()


def test_running_sums_over_ranges(spark):
    rows = [(k * 37 % 1000 // 3, k, k % 5) for k in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long, v long")
    got = {(r.a, r.b): (r._at, r.s) for r in common.running(df, [F.col("a").desc(), F.col("b").asc()], {"s": "v"}, "t").collect()}
    total = 0
    for at, (a, b, v) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1):
        total += v
        assert got[a, b] == (at, total)
    assert common.running(df.limit(0), [F.col("a").asc()], {"s": "v"}, "t").count() == 0
