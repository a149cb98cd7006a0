"""Alignment, hard negatives and min-hash groups against brute force, and odd tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm import alignment, hard_negatives, minhash
from test_llm import ODD, SF, brute_similar, docs_of, table, words_of

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# alignment


def spans(tokens):
    ends = np.cumsum([len(t) for t in tokens]).tolist()
    return list(zip([0, *ends], ends))


def brute_alignment(rows):
    tokenizer, model = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tokenizer.encode_special_tokens = True
    names = {i: t for t, i in tokenizer.get_vocab().items()}
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    found, counts = [], Counter()
    for doc_id, text in rows:
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        of_a = [bytes(letters[c] for c in names[i]) for i in a]
        of_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = b" " + (text or "").encode()
        if not text or b"".join(of_a) != raw or b"".join(of_b) != raw:
            a, b, of_a, of_b = [], [], [], []
        at_a, at_b, first, links = spans(of_a), spans(of_b), 0, []
        for x, (start, end) in enumerate(at_a):
            while at_b[first][1] <= start:
                first += 1
            y = first
            while y < len(b) and at_b[y][0] < end:
                links.append((x, y))
                y += 1
        groups, x, y = [], 0, 0
        for end in sorted({e for _, e in at_a} & {e for _, e in at_b}):
            to_x = next((k for k in range(x, len(a)) if at_a[k][1] > end), len(a))
            to_y = next((k for k in range(y, len(b)) if at_b[k][1] > end), len(b))
            groups.append(",".join(map(str, a[x:to_x])) + "|" + ",".join(map(str, b[y:to_y])))
            x, y = to_x, to_y
        counts.update((a[x], b[y]) for x, y in links)
        found.append((doc_id, a, b, groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = []
    for doc_id, a, b, groups, links in found:
        own = [(counts[a[x], b[y]], best[b[y]]) for x, y in links]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((doc_id, len(a), len(b), len(groups), len(links), sum(n == m for n, m in own), sum(n for n, _ in own), digest))
    return Counter(rows)


ODD_TEXTS = [
    (1, "<|endoftext|> x <s> </s> <unk>"), (2, "\x00a▁b"), (3, "  a  b \t\n x  "), (4, None), (5, ""), (None, "ﬁ ① Ａ"),
    (6, "😀👩‍👩‍👧 𝄞"), (6, "😀👩‍👩‍👧 𝄞"), (7, "a" * 3000), (8, "\n"), (9, "wort " * 3000), (10, "x" * 100_000), (11, " "),
]


@pytest.mark.parametrize("most_frequent", [alignment.MOST_FREQUENT, 50, 0])
def test_alignment_equals_brute_force(spark, most_frequent):
    docs = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string").unionByName(table(spark).select("doc_id", "text").limit(60))
    clash = docs.withColumns({c: F.lit("x") for c in ("row", "code", "a_ids", "n", "best", "rare")}).cache()
    got = alignment.score_links(clash, BYTES, PIECES, most_frequent).collect()
    assert Counter(tuple(r) for r in got) == brute_alignment([(r["doc_id"], r["text"]) for r in clash.collect()])


def test_aligned_lists_and_nothing(spark):
    rows = alignment.align(spark.createDataFrame(ODD_TEXTS, "doc_id long, text string"), BYTES, PIECES).collect()
    for r in rows:
        assert sum(r["a_counts"]) == len(r["a_ids"]) and sum(r["b_counts"]) == len(r["b_ids"])
        assert len(r["a_counts"]) == len(r["b_counts"]) and all(r["a_counts"]) and all(r["b_counts"])
    assert sorted(len(r["a_ids"]) == 0 for r in rows) == [False] * 10 + [True] * 3
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(nothing, BYTES, PIECES).collect() == alignment.score_links(nothing, BYTES, PIECES).collect() == []


# hard negatives


def brute_negatives(rows, scale=256):
    fit = [
        (k, i, [int(np.floor(x * scale)) for x in v], label)
        for k, (i, v, label) in enumerate(rows)
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = Counter()
    for place, anchor, vector, label in fit:
        if anchor is None or anchor % 100:
            continue
        others = [(-sum(map(int.__mul__, vector, v)), i is None, i or 0, k, i, own) for k, i, v, own in fit if k != place and len(v) == len(vector)]
        others.sort(key=lambda r: r[:4])
        for least, _, _, _, positive, _ in [r for r in others if r[5] == label][:5]:
            window = [r for r in others if r[5] != label and -30 * least <= -100 * r[0] <= -90 * least][:10]
            out.update((anchor, positive, k, r[4], -least, -r[0]) for k, r in enumerate(window, 1))
    return out


def test_negatives_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(6)], rng.randrange(3)) for k in range(900)]
    rows += [(1000 + k, [0.5] * 6, k % 3) for k in range(150)]  # ties
    rows += [(2000 + k, [0.0] * 6, k % 2) for k in range(40)]  # zero scores: a tie may lie before its positive
    rows += [(100, [0.5] * 6, 1), (100, [0.5] * 6, 1), (None, [0.5] * 6, 1), (None, [0.4] * 6, 2)]
    rows += [(3000, None, 1), (3100, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1), (3200, [float("nan")] * 6, 1), (3300, [float("inf")] * 6, 1), (3400, [0.2] * 6, None)]
    rows += [(3500, [], 1), (3501, [], 1), (3502, [], 2), (3600, [0.1, 0.2], 1), (3601, [0.3, 0.2], 1), (3602, [0.2, 0.1], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(7)
    clash = vectors.withColumns({c: F.lit(1) for c in ("place", "id", "vector", "salt", "windows", "anchor")})
    got = Counter(tuple(r) for r in hard_negatives.mine(clash).collect())
    assert got == brute_negatives(rows) and sum(got.values()) > 300
    assert hard_negatives.mine(vectors.limit(0)).collect() == []


def test_negatives_of_large_components(spark):
    rows = [(100 * k, [1e8 * (k + 1), 3.0], k % 2) for k in range(12)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert Counter(tuple(r) for r in hard_negatives.mine(vectors, scale=1).collect()) == brute_negatives(rows, 1)


# min-hash groups


def edits(rng, words, many, most, first):
    """One text of 400 words and edits of it."""
    base = [rng.choice(words) for _ in range(400)]
    for k in range(many):
        own = list(base)
        for _ in range(rng.randint(1, most)):
            own[rng.randrange(400)] = rng.choice(words)
        yield first + k, " ".join(own)


def test_min_hash_groups_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    rows = [*edits(rng, words, 400, 9, 0)]
    for k in range(200):
        own = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        other = list(own)
        other[rng.randrange(len(own))] = rng.choice(words)
        rows += [(1000 + 3 * k, " ".join(own)), (1001 + 3 * k, " ".join(rng.choice((other, own[1:])))), (1002 + 3 * k, " ".join(own).upper() + " x")]
    rows += [(i, t) for i, t, *_ in ODD] + [(None, "zz yy xx"), (None, "zz yy xx"), (5004, "one two three four five"), (5004, "one two three four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    clash = docs.withColumns({c: F.lit("x") for c in ("row", "key", "node", "band", "n", "root", "codes", "first", "text_sha256")}).cache()
    rows = [(r["doc_id"], r["text"]) for r in clash.collect()]
    for percent in (85, 80):
        got = minhash.similar_groups(clash, percent).collect()
        roots, ids = brute_similar([t for _, t in rows], percent), {}
        for (i, _), root in zip(rows, roots):
            ids[root] = min((x for x in (ids.get(root), i) if x is not None), default=None)
        sizes = [len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0 for w in (words_of(t) for _, t in rows)]
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == Counter(
            (i, n, ids[root], i == ids[root]) for (i, _), n, root in zip(rows, sizes, roots)
        )
        assert sum(r["stays"] for r in got) == len(set(roots))
    assert minhash.similar_groups(docs.limit(0)).collect() == []


def test_densified_bins_estimate_similarity():
    rng = np.random.default_rng(5)
    for size in (8, 40, 400):
        agree = []
        for _ in range(200):
            own = rng.integers(0, 1 << 64, size + size // 8, dtype=np.uint64)
            a, b = np.unique(own[: size]), np.unique(own[size // 8 :])
            bins = minhash.sketches([a, b])
            agree.append((bins[0] == bins[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(agree)) < 0.02


def test_edges_stay_in_proportion_to_members(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    made = []
    for many in (200, 400):
        members = spark.createDataFrame([*edits(rng, words, many, 7, 0)], "doc_id long, text string")
        prints = minhash._prints(members, 80, 5, False, "doc_id", "text").withColumn("node", F.col("doc_id"))
        keyed = prints.select("node", "codes", F.explode("bands").alias("band"))
        buckets = keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
        made.append(minhash._candidates(keyed.join(buckets, "band"), 80).count())
    assert made[1] < 3 * made[0] and made[1] < 400 * 32


def test_similar_pairs_of_whole_sets():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(60)]
    got = minhash.similar_pairs(sets, 60)
    want = [[100 * len(np.intersect1d(a, b)) >= 60 * len(np.union1d(a, b)) for b in sets] for a in sets]
    assert (got == np.array(want)).all()
