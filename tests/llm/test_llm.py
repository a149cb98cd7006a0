"""The training-data operators against brute force, round trips, held-out accuracy and odd tables."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from attesta.llm import bpe, common, kneser_ney, language, license_scan, near_copies, packing, quality, simhash, toxicity, url_filter
from attesta.llm.exact_dedup import exact_groups
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null ids, texts and languages, empty and blank texts, repeated rows and ids, ties, a long text.
ODD = [
    (1, "The quick brown fox jumps over the dog.", "en", "a", 1),
    (1, "The quick brown fox jumps over the dog.", "en", "a", 1),
    (2, "the QUICK brown fox jumps over the dog.", None, None, None),
    (3, None, "en", "a", None),
    (4, "", None, "b", 0),
    (None, "the quick brown fox jumps over the dog.", "de", "b", 3),
    (None, None, None, None, None),
    (5, "  \n\t ", "fr", "b", 5),
    (6, "12345 !!! ###", "fr", "b", 5),
    (7, "Éé ÖÄ élan straße", "fr", "b", 5),
    (8, "wort " * 30_000 + "ende", "de", "c", 150_004),
    (8, "other text of one id", "de", "c", 20),
]


def plain_lower(text):
    return (text or "").encode().lower().decode()


def words_of(text):
    return (text or "").encode().lower().split()


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def table(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in table(spark).select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_every_operator_has_one_query():
    numbers = Counter(n.split("_")[0] for n in entry.queries() if n.startswith("op"))
    assert numbers == {f"op{k}": 1 for k in range(1, 14)} and "pipeline" in entry.queries()


# exact copies


def test_exact_groups_of_odd_rows(spark):
    near = [(20 + k, "x" * 5000 + c, "en", "a", 1) for k, c in enumerate("aabcA")]
    rows = exact_groups(docs_of(spark, ODD + near), first_digit=4, digit=8, growth=4).collect()
    groups = defaultdict(list)
    for i, text, *_ in ODD + near:
        groups[plain_lower(text)].append(i)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda x: (x is not None, x))):
            stays = i == keep and i not in sorted(ids, key=lambda x: (x is not None, x))[:k]
            want[(i, keep, len(ids), stays, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in rows) == want
    assert sum(r["kept"] for r in rows) == len(groups)


def test_exact_groups_of_an_empty_table_and_clashing_columns(spark):
    assert exact_groups(docs_of(spark, [])).collect() == []
    clash = docs_of(spark, ODD).withColumns({"group": F.lit(1), "rest": F.lit("x"), "keep_id": F.lit(2), "digit": F.lit(3), "_row": F.lit(1)})
    assert Counter(exact_groups(clash).collect()) == Counter(exact_groups(docs_of(spark, ODD)).collect())


def test_bitmap_never_misses_a_key(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    apart, others = common.beside(rows, rows.where("k % 7 = 0"), ["k"])
    assert apart.where("k % 7 = 0").isEmpty() and apart.count() > 16_000 and apart.count() + others.count() == 20_000


# packing


def test_boundaries_are_optimal():
    rng = random.Random(5)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 60), rng.randint(1, 9))), dtype=np.int64)
        counts = np.array([rng.randint(1, 9) for _ in lengths], dtype=np.int64)
        buckets = rng.randint(1, 4)

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths.tolist(), counts.tolist()))

        chosen = packing.boundaries(lengths, counts, buckets)
        ways = [(*c, int(lengths[-1])) for k in range(buckets) for c in combinations(lengths[:-1].tolist(), k)]
        assert len(chosen) <= buckets and chosen[-1] == lengths[-1] and padding(chosen) == min(map(padding, ways))
    assert packing.boundaries(np.zeros(0, np.int64), np.zeros(0, np.int64), 3) == []


def test_pack_loses_nothing_and_keeps_the_budget(spark):
    rows = packing.pack(docs_of(spark, ODD), most_tokens=1000, buckets=3, batch_tokens=4000).collect()
    per_doc, batches, parts = Counter(), Counter(), defaultdict(list)
    for r in rows:
        assert len(words_of(r["text"])) == r["n_tokens"]
        parts[r["doc_id"]].append(r)
        per_doc[r["doc_id"]] += r["n_tokens"]
        assert (r["bucket"] is None) == (r["n_tokens"] == 0)
        if r["bucket"]:
            assert r["padding"] == r["bucket"] - r["n_tokens"] >= 0
            batches[(r["bucket"], r["batch"])] += r["bucket"]
    want = Counter()
    for i, text, *_ in ODD:
        want[i] += len(words_of(text))
    assert per_doc == want and max(batches.values()) <= 4000
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in rows if r["bucket"]}) == sum(r["bucket"] is not None for r in rows)
    own = Counter(i for i, *_ in ODD)
    for i, text, *_ in ODD:
        if own[i] == 1:
            found = sorted(parts[i], key=lambda r: r["piece"])
            assert [r["piece"] for r in found] == list(range(len(found))) and (found[0]["text"] if text is None else "".join(r["text"] for r in found)) == text
    assert packing.pack(docs_of(spark, [])).collect() == []


def test_pieces_put_together_are_the_text(spark):
    texts = [" \n a b\tc  d \x0b", "a b c d e", "é\u00a0ü\nx  y z\n\n", "one", "  ", "a" * 9 + " " + "語 " * 7]
    rows = packing.pack(docs_of(spark, [(k, t, None, "s", 1) for k, t in enumerate(texts)]), most_tokens=2).collect()
    for k, text in enumerate(texts):
        pieces = sorted((r["piece"], r["text"], r["n_tokens"]) for r in rows if r["doc_id"] == k)
        n = len(words_of(text))
        assert "".join(t for _, t, _ in pieces) == text and [c for *_, c in pieces] == ([2] * (n // 2) + [1] * (n % 2) or [0])


def test_rows_without_id_are_packed_in_many_tasks(spark):
    """Rows of one id do not have to go through one task."""
    docs = docs_of(spark, [(None, f"a b {k}", None, "s", 1) for k in range(3000)])
    rows = packing.pack(docs, batch_tokens=30).collect()
    assert Counter(r["text"] for r in rows) == Counter(f"a b {k}" for k in range(3000))
    assert {(r["batch"], r["slot"]) for r in rows} == {(b, s) for b in range(300) for s in range(10)}


# quality


def test_quality_of_odd_rows(spark):
    rows = quality.clean(docs_of(spark, ODD).withColumns({"words": F.lit(1), "lines": F.lit(2)})).collect()
    assert len(rows) == len(ODD)
    for r, (i, text, *_) in zip(rows, ODD):
        w = (text or "").encode().split()
        assert (r["doc_id"], r["n_words"]) == (i, len(w)) and r["word_chars"] == sum(len(x.decode()) for x in w)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {p for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        assert r["n_repeat_words"] == len(hit)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert quality.clean(docs_of(spark, [])).collect() == []


def test_lines_that_fail(spark):
    prose = "This is a sentence of some length, and it says a thing or two about the world we live in today."
    lines = [prose, "Home | About | Contact | Login", "BUY!! NOW!! FREE!! CASH!! WIN!! BIG!!", "All rights reserved.", "*** --- ***", "Next", prose + " More."]
    row = quality.clean(docs_of(spark, [(1, "\n".join(lines), "en", "a", 1), (2, "\n".join([prose] * 1 + lines[1:3] * 40), "en", "a", 1)])).collect()
    assert row[0]["cleaned_text"] == "\n".join([lines[0], lines[-1]]) and row[0]["n_failed_lines"] == 5
    assert not row[1]["kept"] and row[1]["lost_percent"] > 50


# language model


def brute_scores(docs, modulus=5, held_out=1):
    tokens = [words_of(t) + [None] for _, t in docs]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % modulus == held_out for i, _ in docs]
    count, pairs = Counter(), Counter()
    for t, h in zip(tokens, held):
        if not h:
            count.update(t)
            pairs.update(zip([0] + t[:-1], t))
    before = Counter(w for _, w in pairs)

    def discounts(times):
        n = [times[k] for k in (1, 2, 3, 4)]
        if not (n[0] and n[1]):
            return [0, 0.5, 0.5, 0.5]
        y = n[0] / (n[0] + 2 * n[1])
        found = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        return [0] + [d if 0 < d < k else 0.5 for k, d in enumerate(found, 1)]

    high, low = discounts(Counter(pairs.values())), discounts(Counter(before.values()))
    total, rest = Counter(), Counter()
    for (h, _), c in pairs.items():
        total[h] += c
        rest[h] += high[min(c, 3)]
    left = sum(low[min(c, 3)] for c in before.values()) / len(pairs) if pairs else 1.0

    def unigram(w):
        return (max(before[w] - low[min(before[w], 3)], 0) / len(pairs) if pairs else 0) + left / (len(count) + 1)

    def probability(h, w):
        c = pairs[(h, w)]
        return (max(c - high[min(c, 3)], 0) + rest[h] * unigram(w)) / total[h] if total[h] else unigram(w)

    n, v = sum(count.values()), len(count)
    for (i, _), t, h in zip(docs, tokens, held):
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        yield i, h, len(t), sum(count[w] > 0 for w in t), n, base, sum(math.log10(probability(a, b)) for a, b in zip([0] + t[:-1], t))
    if total:
        h = max(total, key=total.get)
        assert abs(sum(probability(h, w) for w in count) + rest[h] / total[h] * left / (v + 1) - 1) < 1e-9


def close(got, want):
    return got[:5] == want[:5] and all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got[5:], want[5:]))


@pytest.mark.parametrize("odd", [False, True])
def test_language_model_equals_brute_force(spark, documents, odd):
    docs = docs_of(spark, ODD) if odd else table(spark)
    rows = [(i, t) for i, t, *_ in ODD] if odd else documents
    got = kneser_ney.score(docs, kneser_ney.learn(docs, shards=3)).drop("perplexity").collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    want = sorted(brute_scores(rows), key=order)
    assert all(close(tuple(a), b) for a, b in zip(sorted(map(tuple, got), key=order), want)) and len(got) == len(want)
    if not odd:
        held = [w for w in want if w[1]]
        assert sum(w[6] for w in held) > sum(w[5] for w in held)


def test_a_worker_opens_each_file_once(spark, monkeypatch):
    model, opened = kneser_ney.learn(table(spark), shards=3), Counter()
    mapped = kneser_ney._mapped
    monkeypatch.setattr(kneser_ney, "_mapped", lambda folder, name, kinds: opened.update([name]) or mapped(folder, name, kinds))
    monkeypatch.setattr(kneser_ney, "_LOOKUPS", {"an earlier model": None})
    hashes, contexts, tokens, _ = kneser_ney._sequences(pa.array(["the dog the end", "a dog"]))
    logs = [kneser_ney._lookup(model).probabilities(hashes, contexts, tokens)[0].tolist() for _ in range(4)]
    assert logs[1:] == logs[:1] * 3 and set(opened.values()) == {1} and list(kneser_ney._LOOKUPS) == [model.folder]
    one = kneser_ney.Lookup(model)
    one.probabilities(hashes[-2:], np.array([1]), np.array([0]))  # the end after the start
    assert [kind for kind, _ in one._opened].count("pairs") == 1


def test_language_model_of_nothing(spark):
    empty = docs_of(spark, [])
    model = kneser_ney.learn(empty)
    assert kneser_ney.score(empty, model).collect() == []
    row = kneser_ney.score(docs_of(spark, [(1, "a b", "en", "x", 1)]), model).first()
    assert row["n_known"] == 0 and row["score"] == 0.0  # one class, the unknown word


# URLs


def test_rules_and_odd_urls(spark):
    urls = [
        "https://a.com/x", "http://www.example.com/en/1", "http://blog.example.com/en/1", "http://example.com/en/1", "http://EXAMPLE.com/de/1",
        "http://a.net/es/1", "http://a.net/de/1?x=/es/", "http://notcom/x", "http://com", "http://com/", None, "no scheme", "x://h#f", "http://a.org/" + "/".join("abcdefgh"),
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("h"), "template": F.lit("t")})
    labels = spark.createDataFrame([(6, 1), (6, 0), (7, None), (None, 1)], "page_id long, good int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, labels).collect()}
    assert [got[k]["rule"] for k in range(len(urls))] == [
        "com/", "www.example.com/en/", "example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None, "com/", None, None, None, None,
    ]
    assert [got[k]["verdict"] for k in (0, 1, 2, 5)] == ["allow", "allow", "block", "block"]
    assert (got[10]["host"], got[10]["path"]) == ("", "") == (got[11]["host"], got[11]["path"]) and (got[12]["host"], got[12]["path"]) == ("h", "")
    assert got[4]["host"] == "example.com" and got[6]["path"] == "/de/1"
    assert url_filter.judge(pages.limit(0), labels).collect() == []


def test_bad_templates_are_blocked(spark):
    urls = [(k, f"http://a.org/{'spam' if k % 2 else 'news'}/{k}/title-{k}.html") for k in range(200)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(k, 0 if k % 2 else 1) for k in range(0, 120)], "page_id long, good int")
    got = url_filter.judge(pages, labels).collect()
    assert {(r["verdict"], r["page_id"] % 2) for r in got} == {("allow", 0), ("block", 1)}
    assert {r["template"] for r in got} == {"/news/0/title-0.html", "/spam/0/title-0.html"}
    assert {r["verdict"] for r in url_filter.judge(pages, labels.limit(0)).collect()} == {"allow"}


# near copies


def brute_print(text):
    w = words_of(text)
    shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_similar(texts, percent, shingle=5):
    """Number of the first text that links of similar shingle sets reach; empty sets reach nothing."""
    sets, parent = [], list(range(len(texts)))
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def brute_groups(prints, radius=4):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(prints)), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= radius:
            parent[root(a)] = root(b)
    return [root(k) for k in range(len(prints))]


def test_near_groups_equal_brute_force(spark, documents):
    for docs, rows in ((table(spark), documents), (docs_of(spark, ODD), [(i, t) for i, t, *_ in ODD])):
        prints = [brute_print(t) for _, t in rows]
        roots = brute_groups(prints)
        least = {}
        for (i, _), r in zip(rows, roots):
            if i is not None:
                least[r] = min(i, least.get(r, i))
        want = Counter((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, roots))
        got = simhash.near_groups(docs).collect()
        assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
        kept = {(r["doc_id"], r["text_sha256"]) for r in got if r["kept"]}
        assert len(kept) == len(set(roots))
    assert simhash.near_groups(docs_of(spark, [])).collect() == []


@pytest.mark.parametrize("most", [4096, 7])
def test_links_connect_what_brute_force_connects(spark, most):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:20]:  # dense clusters and chains
        for _ in range(12):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            prints.add(p)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), most=most)).collect()
    got = {r["node"]: r["root"] for r in found}
    groups = defaultdict(set)
    for (s,), r in zip(signed, brute_groups(prints)):
        groups[r].add(s)
    assert {s: got.get(s, s) for (s,) in signed} == {s: min(g) for g in groups.values() for s in g}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 500), (700, 600)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(201)}, 600: 600, 700: 600}


def jaccard(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (words_of(a), words_of(b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited_copies(documents):
    """(document, copy, similarity): random words replaced until the five-word similarity is just above 0.8, 0.85, 0.9 or 0.95, and some just below."""
    rng, found = random.Random(12), []
    longer = [t for _, t in documents if len(words_of(t)) >= 120]
    for k in range(60):
        text = longer[k % len(longer)] + f" number {k} of {k * k}"
        words, aim, copy, now = text.split(), (0.8, 0.85, 0.9, 0.95)[k % 4], text, 1.0
        while True:
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**9)}"
            after = jaccard(text, " ".join(words))
            if after < aim:
                break
            copy, now = " ".join(words), after
        found.append((text, copy, now))
        if k % 4 == 0:
            found.append((text, " ".join(words), after))
    return found


def test_near_dedup_stage_takes_edited_copies_from_similarity_080(spark, documents):
    cases = [(" ".join(f"w{k}x{w}" for w in a.split()), " ".join(f"w{k}x{w}" for w in b.split()), s) for k, (a, b, s) in enumerate(edited_copies(documents))]
    rows = [(2 * k + side, t, "en", "a", 1) for k, case in enumerate(cases) for side, t in enumerate(case[:2])]
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs_of(spark, rows), SF).collect()}
    similar = [s >= 0.8 for _, _, s in cases]
    assert True in similar and False in similar
    assert got == {2 * k for k in range(len(cases))} | {2 * k + 1 for k, s in enumerate(similar) if not s}


def test_near_dedup_stage_keeps_one_of_repeated_rows(spark):
    rows = [(1, "one two three four five six", "en", "a", 1)] * 3 + [(2, "quite another text it is", "en", "a", 1), (None, "and a third one", "en", "a", 1)] * 2
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs_of(spark, rows), SF).collect())
    assert got == Counter({(i, t) for i, t, *_ in rows})


def test_similar_groups_equal_brute_force(spark, documents):
    rng, base = random.Random(3), [f"t{k}" for k in range(60)]
    texts = [t for _, t in documents] + [t for _, t, *_ in ODD]
    for _ in range(120):  # one crowd of copies near the threshold, linked in chains
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"e{rng.randrange(40)}"
        texts.append(" ".join(words))
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(texts)]
    roots = brute_similar(texts, 80)
    got = near_copies.similar_groups(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(k, root, root == k) for k, root in enumerate(roots)]
    assert near_copies.similar_groups(docs_of(spark, [])).collect() == []


# toxicity


def test_toxicity_finds_held_out_documents(spark):
    rng = random.Random(4)
    common_words = ["the", "of", "and", "to", "in", "house", "tree", "river", "stone", "cloud"]
    rows, labels = [], []
    for k in range(900):
        w = [rng.choice(common_words) for _ in range(rng.randint(5, 80))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["moron", "idiot!", "SCUM!!"]))
        rows.append((k, " ".join(w), "en", "a", 1))
        labels.append((k, int(toxic)))
    docs, marks = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [k for k in got if got[k]["held_out"]]
    assert held == [k for k in got if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(got[k]["predicted"] == labels[k][1] for k in held) / len(held) > 0.98
    assert toxicity.keep_clean(docs, model).count() == sum(r["predicted"] == 0 for r in got.values())
    odd = toxicity.score(docs_of(spark, ODD).withColumns({"score": F.lit(9), "place": F.lit(1)}), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, ODD)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), none)).collect() == []


def test_toxicity_learns_from_the_same_documents_beyond_the_limit(spark):
    rng = random.Random(8)
    texts = {k: " ".join(rng.choice(["scum", "moron"] if k % 4 == 0 and rng.random() < 0.3 else ["river", "tree", "stone", "cloud", "of"]) for _ in range(rng.randint(20, 200))) for k in range(300)}
    rows = [(k, t, "en", "a", 1) for k, t in texts.items()]
    marks = spark.createDataFrame([(k, int(k % 4 == 0)) for k in texts], "doc_id long, toxic int")
    ways = [docs_of(spark, rows).repartition(5, "doc_id"), docs_of(spark, rows[::-1]).coalesce(1), docs_of(spark, sorted(rows, key=lambda r: r[0] % 4)).repartition(3)]
    models = [toxicity.learn(d, marks, most_features=4000, l1=0.5) for d in ways]
    assert all(m.places.tolist() == models[0].places.tolist() and m.weights.tolist() == models[0].weights.tolist() and m.bias == models[0].bias for m in models)
    assert len(models[0].places) and models[0].weights.min() < 0 < models[0].weights.max()  # both labels are learned from
    sizes = pa.table({"place": [5, 1, 9, 3, 7, 2], "label": [0, 0, 0, 0, 1, 1], "size": [10] * 6})
    assert toxicity._last_places(sizes, 60) == {0: 9, 1: 7} and toxicity._last_places(sizes, 35) == {0: 3, 1: 2} and toxicity._last_places(sizes, 5) == {}


def test_ftrl_by_hand():
    rows = [(np.array([1, 5]), 1), (np.array([5]), 0), (np.array([1]), 1)] * 3
    model = toxicity.ftrl(rows, 0.5, 1.0, 0.1, 0.2, 2)
    z, n = Counter(), Counter()
    weight = {1: 3 / 6, 0: 1.0}

    def w(i):
        l1 = 0.0 if i == "b" else 0.1
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((1 + math.sqrt(n[i])) / 0.5 + 0.2)

    for _ in range(2):
        for places, label in rows:
            at = [*places.tolist(), "b"]
            ws = [w(i) for i in at]
            g = (1 / (1 + math.exp(-sum(ws))) - label) * weight[label]
            for i, x in zip(at, ws):
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * x
                n[i] += g * g
    assert model.bias == pytest.approx(w("b")) and dict(zip(model.places.tolist(), model.weights.tolist())) == pytest.approx({1: w(1), 5: w(5)})


# licences


def test_licences_in_comments_paragraphs_and_lines(spark):
    apache = (
        '/*\n * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License.\n'
        " * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n */"
    )
    texts = [apache, "foo bar\nReleased under the MIT License.\nx", "Text. Licensed under CC BY-NC 4.0. All rights reserved.", None, "", "no licence here, with no permission"]
    docs = docs_of(spark, [(k, t, "en", "a", 1) for k, t in enumerate(texts)]).withColumns({"found": F.lit(1), "marked": F.lit(True)})
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert [got[k]["licenses"] for k in range(6)] == [["Apache-2.0"], ["MIT"], ["CC-BY-NC-4.0", "LicenseRef-all-rights-reserved"], [], [], []]
    assert got[0]["paragraph_ids"] == [2, 3] and got[2]["category"] == "proprietary" and got[3]["category"] == "none"
    assert license_scan.scan(docs.limit(0)).collect() == []


def test_every_known_sentence_has_a_marker_and_is_found(spark):
    assert all(any(m in s.lower() for m in license_scan.MARKERS) for s in license_scan.SENTENCES.values())
    rows = [(i, f"Some text. {s}. Other text.", "en", "a", 1) for i, s in license_scan.SENTENCES.items()]
    assert all(r["line_ids"] == r["paragraph_ids"] == [r["doc_id"]] for r in license_scan.scan(docs_of(spark, rows)).collect())


def test_known_sentences_are_found_however_they_are_wrapped(spark):
    rows = []
    for i, s in license_scan.SENTENCES.items():
        words = s.split()
        for k in range(1, len(words)):
            for lead in ("", "# ", "// ", " * "):
                rows.append((i, f"{lead}{' '.join(words[:k])}\n{lead}{' '.join(words[k:])}.", "en", "a", 1))
            rows.append((i, f"Some text. {' '.join(words[:k])} \t {' '.join(words[k:])}. Other text.", "en", "a", 1))
    assert all(r["paragraph_ids"] == [r["doc_id"]] for r in license_scan.scan(docs_of(spark, rows)).collect())
    wrapped = ["All rights\nreserved.", "# All rights\n# reserved.", "// All rights\n// reserved.", "All  rights  reserved.", "All rights, reserved."]
    got = license_scan.scan(docs_of(spark, [(k, t, "en", "a", 1) for k, t in enumerate(wrapped)])).collect()
    assert [r["category"] for r in got] == ["proprietary"] * len(wrapped)


# BPE


def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_bpe_equals_the_tokenizers_library():
    rng = random.Random(3)
    letters = "aaab  \n\t'sé ñ1２3<|endoftext|>\x1c\x85\u3000\u200b漢字🙂!?..,--LL'll\r\x0b"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "aaaaaaaaaaaaa", "ab" * 50 + "\n\n  x", "x" * 5000]
    theirs, vocabulary = reference_tokenizer(), bpe.Vocabulary(bpe._load(VOCABULARY))
    ids, counts = bpe.Encoder(vocabulary).encode(texts)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for text, own, want in zip(texts, parts, theirs.encode_batch(texts, add_special_tokens=False)):
        assert own.tolist() == want.ids
        assert bpe._text(vocabulary, own) == theirs.decode(want.ids, skip_special_tokens=False) == text
    broken = np.array([200, 10, 150], dtype=np.int32)
    assert bpe._text(vocabulary, broken) == theirs.decode(broken.tolist(), skip_special_tokens=False)


def test_bpe_of_tables(spark, documents):
    theirs = reference_tokenizer()
    rows = documents + [(i, t) for i, t, *_ in ODD]
    docs = table(spark).select("doc_id", "text").unionByName(docs_of(spark, ODD).select("doc_id", "text"))
    got = Counter(tuple(r) for r in bpe.digests(bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for (i, t), e in zip(rows, theirs.encode_batch([t or "" for _, t in rows], add_special_tokens=False)):
        want[(i, len(e.ids), sha(",".join(map(str, e.ids))), sha(theirs.decode(e.ids, skip_special_tokens=False)))] += 1
    assert got == want
    assert bpe.encode(docs.limit(0), VOCABULARY).collect() == []


def test_bpe_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    theirs, encoder = reference_tokenizer(), bpe.Encoder(bpe.Vocabulary(bpe._load(VOCABULARY)))
    for text in ("one two three four", "two five six", "one <|endoftext|> seven"):
        assert encoder.encode([text])[0].tolist() == theirs.encode(text, add_special_tokens=False).ids


# language


def brute_bundle(text, dimensions=64, order=3):
    marks = [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
    marks = [c for k, c in enumerate(marks) if c or not k or marks[k - 1]]
    total = np.zeros(dimensions, dtype=np.int64)
    for k in range(len(marks) - order + 1):
        bound = np.ones(dimensions, dtype=np.int64)
        for j, c in enumerate(marks[k : k + order]):
            bound *= np.roll(language._letter_vector(c, dimensions), order - 1 - j)
        total += bound
    return total


def test_bundles_equal_brute_force():
    texts = ["Hello, wörld!", "a", None, "", "12 !", "漢字 кот " * 3, "ǅ x"]
    vectors, grams = language.bundles(texts, 3, 64)
    for k, t in enumerate(texts):
        if t and any(c.isalpha() for c in t):
            assert (vectors[k] == brute_bundle(t)).all() and grams[k] > 0
        else:
            assert grams[k] == 0 and not vectors[k].any()


def test_languages_of_held_out_documents(spark):
    docs = table(spark)
    profiles = language.learn(docs)
    found = language.predict(docs, profiles).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.95 and all(0 <= r["score"] <= 1 for r in found)
    odd = language.predict(docs_of(spark, ODD).withColumn("held_out", F.lit(1)), profiles).collect()
    assert len(odd) == len(ODD)
    assert [r["lang_pred"] == "und" for r in odd] == [not any(c.isalpha() for c in t or "") for _, t, *_ in ODD]
    nothing = language.learn(docs.where(F.col("lang") == "xx"))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}


def test_languages_of_a_long_text_need_little_memory():
    rng = random.Random(1)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(3_500_000))
    tracemalloc.start()
    language.bundles([text], 3, 1024)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20


def test_texts_unlike_all_languages_go(spark):
    docs = table(spark)
    rows = [(1, "漢字仮名交文" * 100, None, "a", 1), (2, "漢字", None, "a", 1), (3, "12 34", None, "a", 1)]
    profiles = language.learn(docs)
    assert [r["doc_id"] for r in language.keep_known(docs_of(spark, rows), profiles).collect()] == [2]
    nothing = language.learn(docs.where(F.col("lang") == "xx"))
    assert [r["doc_id"] for r in language.keep_known(docs_of(spark, rows), nothing).collect()] == [1, 2]


# pipeline


def test_pipeline_equals_its_parts(spark, documents):
    docs = table(spark).unionByName(docs_of(spark, ODD).where("doc_id is null or doc_id > 2").withColumn("doc_id", F.col("doc_id") + 9000))
    labels = table(spark, "labels")
    now, seen = docs, []
    for name, step in corpus_pipeline.STAGES:
        now = step(spark, now, SF)
        rows = now.collect()
        seen.append(Counter((r["doc_id"], r["text"]) if "text" in r else (r["doc_id"],) for r in rows))
        if name != "packing":
            assert now.columns == docs.columns
            now = docs_of(spark, [tuple(r) for r in rows])
    known = Counter({(i, t): n for (i, t), n in Counter((r["doc_id"], r["text"]) for r in docs.collect()).items() if t and any(c.isalpha() for c in t)})
    assert not seen[0] - known and all(set(words_of(t)) == {b"wort", b"ende"} for _, t in known - seen[0])  # like no language learned
    marked = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    lost = seen[0] - seen[1]
    assert all(i in marked for i, _ in lost if i in {r["doc_id"] for r in labels.collect()}) and not (seen[1] - seen[0])
    by_text = {}
    for i, t in seen[1]:
        key = plain_lower(t)
        by_text[key] = max(by_text.get(key, (False, 0, t)), (i is not None, i or 0, t))
    assert sorted(plain_lower(t) for _, t in seen[2].elements()) == sorted(by_text)
    assert {(i, plain_lower(t)) for i, t in seen[2]} == {(i if own else None, key) for key, (own, i, _) in by_text.items()}
    rest = sorted(seen[2], key=lambda r: (r[0] is None, r[0] or 0))
    firsts = {}
    for r, root in zip(rest, brute_similar([t for _, t in rest], 80)):
        firsts.setdefault(root, r)
    assert seen[3] == Counter(firsts.values())
    # a text of at most 4096 words is one piece
    assert {r for r in seen[4] if len(words_of(r[1])) < 4096} >= {r for r in seen[3] if len(words_of(r[1])) < 4096}
    assert {i for i, _ in seen[4]} == {i for i, _ in seen[3]}


CLASHING = ["_id", "_digest", "_row", "_bit", "_bits", "id", "digest", "row", "kept", "group", "node", "key", "bands"]


def test_stages_carry_columns_of_any_name(spark, documents):
    docs = table(spark).unionByName(docs_of(spark, ODD[2:]).withColumn("doc_id", F.col("doc_id") + 9000))
    clash = docs.withColumns({c: F.concat(F.lit(c), F.coalesce("text", F.lit(""))) for c in CLASHING})
    for name, step in corpus_pipeline.STAGES:
        plain, other = step(spark, docs, SF).collect(), step(spark, clash, SF).collect()
        if name == "packing":
            assert Counter(plain) == Counter(other)
        else:
            assert Counter(tuple(r) for r in plain) == Counter(tuple(r)[: len(docs.columns)] for r in other)
            assert all(r[c] == c + (r["text"] or "") for r in other for c in CLASHING)


def test_pipeline_of_nothing(spark):
    now = docs_of(spark, [])
    for _, step in corpus_pipeline.STAGES:
        now = step(spark, now, SF)
        assert now.collect() == []
