"""The training-data operators against brute force, exact round trips and held-out accuracy, and on awkward tables."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.llm import ann, decontaminate, jaccard, langid, licenses, packing, queries, revisits, sharding, toxicity, urlfilter
from logspark.llm.common import ngram_set, with_rank

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in "ba ke ti no su ra mi fo".split() for b in "l n r s t la ne ri".split()]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choices(VOCABULARY, k=n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns with names that operators use."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "   \n\t", "en", "s"), (4, "!!! ???", None, "s"), (5, "word", "en", None), (None, "an id is missing here today", "en", "s"),
            (7, long, "en", "s"), (8, long, "en", "s"), (9, "same same same", "en", "s"), (9, "same same same", "en", "s"), (10, "ＦＵＬＬ width Σίσυφος İ ß é \x00   x", "de", "s")]
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)
    for c in ("key", "hash", "size", "score", "shard", "_bucket", "rep", "length", "predicted"):
        df = df.withColumn(c, F.lit(1))
    return df


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


# 1 -------------------------------------------------------------------------------------------------------------------

ITEMS = [
    (1, "If Anna buys 12 apples at 3 dollars each in Boston then how many dollars does she pay for the apples in total before any discount"),
    (2, "The quick brown fox jumps over the lazy dog while seventeen curious geese watch from behind the old wooden fence"),
    (3, "short item of five words"),
    (4, None),
]


def leaks(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}


def test_leaks_are_found_with_other_values(spark):
    rng = random.Random(1)
    swapped = "If Bob buys 40 apples at 7 dollars each in Madrid then how many dollars does she pay for the apples in total before any discount"
    units = ITEMS[0][1].replace("12", "5").replace("3 dollars", "9 euros")
    got = leaks(spark, [prose(rng, 80) + ". " + ITEMS[0][1] + ". " + prose(rng, 50), swapped, prose(rng, 300), ITEMS[1][1].upper(), "x y. " + ITEMS[2][1] + " and z", None, "", units])
    assert got[(0, 1)] is True and got[(1, 1)] is False
    assert got.keys() == {(0, 1), (1, 1), (3, 2), (4, 3), (7, 1)}


def test_slots_must_be_consistent(spark):
    item = "Take Anna to the big red barn and give Anna some of the fresh warm milk before Anna goes home again"
    docs = spark.createDataFrame([(1, item.replace("Anna", "Bert")), (2, item.replace("Anna", "Bert", 1).replace("give Anna", "give Carl").replace("before Anna", "before Dora"))], "doc_id long, text string")
    got = {r["doc_id"] for r in decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1}


def leaked(spark, item, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}


def test_a_conflict_costs_its_windows_only(spark):
    long = "After lunch we paid 2 coins for the red kite and " + prose(random.Random(21), 12) + " then we paid 2 coins for the blue kite and went home"
    roles = "At noon she buys 2 apples at 2 dollars each and 2 pears while her sister waits outside near the old gate"
    assert leaked(spark, long, [long.replace("2 coins for the blue", "3 coins for the blue")]).keys() == {0}
    assert leaked(spark, roles, [roles.replace("2 apples", "3 apples").replace("2 dollars", "4 dollars").replace("2 pears", "5 pears")]).keys() == {0}


def test_names_that_begin_sentences_and_other_case(spark):
    tom = "Tom has 3 apples. Mary has 5 apples. Tom gives 2 to Mary. How many apples does Tom have now?"
    other = "Bob has 7 apples. Lucy has 9 apples. Bob gives 4 to Lucy. How many apples does Bob have now?"
    assert leaked(spark, tom, [other, tom]).keys() == {0, 1}
    names = "Der Hund von Anna jagt die Katze von Peter durch den Garten und bellt laut vor der Hecke von Berta"
    assert leaked(spark, names, [names.lower(), names.upper(), names]).keys() == {0, 1, 2}


def test_verbatim_passages_and_items_poor_in_words(spark):
    rng = random.Random(22)
    item = prose(rng, 59)
    part = " ".join(item.split()[10:35])
    thirteen = " ".join(item.split()[40:53])
    assert leaked(spark, item, [part, prose(rng, 40) + " " + thirteen + " " + prose(rng, 40), " ".join(item.split()[40:51])]).keys() == {0, 1}
    numbers = "12 kg 7 lb 90 cm 14 mm 3 Anna 5 Bert 8 Carl 61 kg 77 lb"
    got = leaked(spark, numbers, [prose(rng, 20) + " " + numbers + " " + prose(rng, 20), numbers.replace("12", "13").replace("90", "91").replace("61", "62").replace("8", "9")])
    assert got.keys() == {0} and got[0]["exact"] and got[0]["coverage"] == 1


def test_templates_hash_alike():
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(["Anna ", "bob ", "5 ", "kg ", "Kg ", ". ", "\n", "ONE ", "Two ", "% ", "3,5 ", "it's "]) for _ in range(30))
        assert (decontaminate.token_hashes(decontaminate.template(t)[0]) == decontaminate.template_hashes(t)).all()


# 2 -------------------------------------------------------------------------------------------------------------------


def test_texts_read_together_are_as_read_alone():
    # A number ends a text and a unit begins the next, names meet, and texts are empty or only stops.
    texts = ["she bought 5", "kg of Rice and met Tom", "Tom Smith went home.", None, "", "...", "Anna", "Bob saw 7 km"]
    together = decontaminate._hashes_of_texts(texts)
    for k, t in enumerate(texts):
        for (h, of), alone in zip(together, decontaminate._reading_hashes(t), strict=True):
            assert h[of == k].tolist() == alone.tolist()
        assert together[1][0][together[1][1] == k].tolist() == decontaminate.token_hashes(decontaminate.template(t)[0]).tolist()
        assert together[2][0][together[2][1] == k].tolist() == decontaminate.token_hashes(decontaminate.template(t, True)[0]).tolist()


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(30):
        base = prose(rng, rng.randint(5, 120)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
            texts.append(" ".join(copy))
    texts += ["one two", "one two", "One, two!", "", None, "x"]
    sets = [frozenset(ngram_set(t).tolist()) for t in texts]
    links, parent = Counter(), list(range(len(texts)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    old, jaccard.BLOCK = jaccard.BLOCK, 3  # so that clusters take several blocks
    try:
        got = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.near_duplicates(df).collect()}
    finally:
        jaccard.BLOCK = old
    assert got == {i: (root(i), links[i]) for i in range(len(texts))}


def test_near_duplicates_without_ids_and_with_shared_ids(spark):
    rng = random.Random(31)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(None, a), (None, a), (1, a + " more"), (5, a), (5, b), (6, a + " again"), (7, b + " again"), (None, None), (None, "")]
    got = Counter((r["doc_id"], r["class_id"], r["links"], r["copies"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(None, 1, 4, 3): 2, (1, 1, 4, 1): 1, (5, 1, 4, 3): 1, (6, 1, 4, 1): 1, (5, 5, 1, 1): 1, (7, 5, 1, 1): 1, (None, None, 0, 1): 2})


def test_a_chain_of_near_copies_is_one_class(spark):
    rng = random.Random(32)
    words = prose(rng, 400).split()
    texts = [" ".join(words[k : k + 100]) for k in range(0, 300, 5)]
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    # Of 96 n-grams, neighbours share 91 (0.90), the next 86 (0.81) and those after them 81 (0.73).
    assert {r["class_id"] for r in got} == {0} and Counter(r["links"] for r in got) == Counter({2: 2, 3: 2, 4: 56})


def test_bands_reach_recall():
    bands, rows = jaccard.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= jaccard.MAX_HASHES


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 202), (300, 300)]
    got = {r["node"]: r["component"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200}


# 3 -------------------------------------------------------------------------------------------------------------------


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 4000), rng.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 7}", 0) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS), leaves=11).collect()
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["size"] == len(rows[r["doc_id"]][1]) + 16 and r["text_crc32"] == zlib.crc32(rows[r["doc_id"]][1].encode())
    mean = sum(sizes.values()) / 11
    assert sorted(sizes) == list(range(11)) and max(abs(s - mean) for s in sizes.values()) < 8100
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_by_target(spark):
    rows = [(i, "x" * 84, "en", "s", 0) for i in range(100)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS), target_bytes=2600)
    assert got.select("shard").distinct().count() == 4
    assert sharding.shard(empty(spark), leaves=5).count() == 0


def test_ranks_are_gapless(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    got = with_rank(df, ["k"], ["id"], "r", 500).groupBy("k").agg(F.countDistinct("r").alias("d"), F.max("r").alias("m"), F.count("r").alias("n")).collect()
    assert all(r["d"] == r["n"] == r["m"] + 1 for r in got)


# 4 -------------------------------------------------------------------------------------------------------------------


def test_automaton_equals_regular_expressions():
    import re

    rng = random.Random(6)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**"]) for _ in range(rng.randint(1, 12))).replace("***", "**") for _ in range(40)] + ["", "*", "**"]
    texts = ["".join(rng.choices("ab/é", k=rng.randint(0, 12))) for _ in range(300)] + [""]
    got = urlfilter.Automaton(globs).run(texts)
    for k, g in enumerate(globs):
        pattern = "".join({"*": "[^/]*", "**": ".*"}.get(p) or re.escape(p) for p in re.findall(r"\*\*|\*|[^*]", g))
        assert [bool(re.fullmatch(pattern, t, re.S)) for t in texts] == got[:, k].tolist(), g


def test_urls_are_judged(spark):
    urls = ["http://A.example.com/en/7x", "https://example.com/en/8", "http://other.com/en/7", "http://com/en/", "http://xcom/en/", "http://a.net/de/", "http://b.example.net/de/8?q", "ftp://a.org/es/#f", "http://a.org", "no scheme", None, "://", "http://a.b/x.com/en/"]
    got = [tuple(r)[1:] for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.URL_RULES).orderBy("page_id").collect()]
    assert got == [
        ("a.example.com", "/en/7x", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"), ("other.com", "/en/7", "com/en/", "block"), ("com", "/en/", "com/en/", "block"), ("xcom", "/en/", None, "allow"),
        ("a.net", "/de/", "net/de/", "allow"), ("b.example.net", "/de/8", "example.net/de/8", "block"), ("a.org", "/es/", "org/es/", "block"), ("a.org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.b", "/x.com/en/", None, "allow")]


# 5 -------------------------------------------------------------------------------------------------------------------


def test_revisits(spark):
    h = {"etag": "a", "content-length": "5"}
    rows = [(1, "http://www.A.com/x/", 10, "response", "a", "d1", "p1", h), (2, "https://a.com/x#f", 20, "revisit", "a", None, None, {"Etag": "b", "content-length": "0", "server": "s"}), (3, "http://a.com/x", 30, "response", "b", "d2", "p2", {}),
            (4, "http://a.com/x", 40, "revisit", "a", None, None, None), (5, "http://a.com/x", 50, "revisit", None, "d2", None, {}), (6, "http://a.com/x", 5, "revisit", "a", None, None, {}), (7, "http://a.com/x", 60, "revisit", None, None, None, {}),
            (8, None, 60, "revisit", "a", None, None, {}), (9, "http://a.com/x", None, "revisit", "b", None, None, {}), (11, "http://a.com/x", 70, "revisit", 'W/"b"', None, None, {}), (12, "http://a.com/x", 65, "response", '"b"', "d3", "p4", {}), (10, "http://a.com/x", None, "response", "z", None, "p3", {})]
    got = {r["record_id"]: (r["status"], r["response_id"], r["headers"]) for r in revisits.resolve(spark.createDataFrame(rows, "record_id long, url string, time long, kind string, etag string, last_modified string, digest string, headers map<string,string>")).collect()}
    assert got[2] == ("resolved", 1, {"Etag": "b", "content-length": "5"})
    assert {k: v[:2] for k, v in got.items() if k != 2} == {4: ("mismatch", None), 5: ("resolved", 3), 6: ("no_response", None), 7: ("no_validator", None), 8: ("no_url", None), 9: ("no_time", None), 11: ("resolved", 12)}


# 6 -------------------------------------------------------------------------------------------------------------------


def test_segments_equal_the_definition():
    """Maximal segments, found by repeatedly taking the best one and recursing on both sides."""
    rng = random.Random(7)

    def best(s, at, end):
        found = max(((sum(s[a:b]), -(b - a), a, b) for a in range(at, end) for b in range(a + 1, end + 1)), default=None)
        if not found or found[0] <= 0:
            return []
        _, _, a, b = found
        return [*best(s, at, a), (a, b), *best(s, b, end)]

    for _ in range(150):
        signed = [rng.choice([-0.5, -0.5, -1.0, -0.25, 1.25, 0.75, 2.0]) for _ in range(rng.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(signed))] == best(signed, 0, len(signed))


def test_toxic_documents_are_told(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(700):
        toxic = i % 8 == 0
        text = prose(rng, rng.randint(20, 200)).split()
        for _ in range(rng.randint(2, 5) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["zagnob", "frukel", "drobs" + rng.choice(VOCABULARY)]))
        rows.append((i, " ".join(text)))
        if i < 500:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(500, 700)]
    assert sum(got[i]["predicted"] == (i % 8 == 0) for i in held) >= 0.98 * len(held)
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0 and 0 <= got[1000]["score"] < 0.5
    some = next(got[i] for i in held if i % 8 == 0)
    assert some["passages"] and rows[some["doc_id"]][1][some["passages"][0]["start"] :].split()[0].startswith(("zagnob", "frukel", "drobs"))
    blank = toxicity.fit(docs, empty(spark, "doc_id long, toxic int"))
    assert toxicity.score(docs, blank).where("predicted = 1").count() == 0


# 7 -------------------------------------------------------------------------------------------------------------------


def test_alignment_is_a_common_subsequence():
    rng = random.Random(9)
    for _ in range(200):
        a, b = (rng.choices("abcdefghij", k=rng.randint(0, 12)) for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
        values = [rng.randint(0, 9) for _ in range(10)]
        kept = [values[i] for i in licenses.increasing(values)]
        longest = max(n for n in range(11) for c in itertools.combinations(values, n) if list(c) == sorted(set(c)))
        assert len(kept) == longest and kept == sorted(set(kept))


def test_gaps_without_unique_words_are_aligned():
    assert licenses.align("a b a b a b x".split(), "q a b a b a b y".split()) == [(i, i + 1) for i in range(6)]
    rng = random.Random(24)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 10)) for _ in range(2))
        longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                longest[i + 1][j + 1] = longest[i][j] + 1 if x == y else max(longest[i][j + 1], longest[i + 1][j])
        assert len(licenses.common(a, b, 0, len(a), 0, len(b))) == longest[-1][-1]


def test_notices_are_found(spark):
    rng = random.Random(10)
    apache = licenses.TEMPLATES["apache-2.0"]
    texts = [prose(rng, 500) + "\n" + apache + "\n" + prose(rng, 900) + " " + apache, apache.replace("Version ", "v "), licenses.TEMPLATES["mit-text"].replace("free of charge,", "without charge").upper(), prose(rng, 400), "the License under the", None, ""]
    got = {(r["doc_id"], r["license"]): (r["coverage"], r["passages"]) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[(0, "apache-2.0")] == (1.0, 2) and (1, "apache-2.0") in got and got[(2, "mit-text")][0] > 0.9
    assert {k[0] for k in got} == {0, 1, 2}


def test_notices_at_every_offset_and_in_a_row():
    rng = random.Random(23)
    template = [f"t{i}" for i in range(100)]

    def found(text, template=template):
        return licenses.passages(text, np.array([w in set(template) for w in text], np.int64), template, 0.8)

    spread = [w for k, w in enumerate(template) if k % 7 != 3]
    for _ in range(65):
        spread.insert(rng.randrange(1, len(spread)), "gap")
    for offset in range(0, 201, 5):
        got = found(["x"] * offset + spread + ["x"] * 300)
        assert [(f[1], f[2]) for f in got] == [(offset, offset + len(spread))] and got[0][0] >= 0.84
    for name in licenses.TEMPLATES:
        notice = licenses.words(licenses.TEMPLATES[name])
        for offset in (0, 37):
            got = found(["x"] * offset + notice * 5 + ["x"] * 40, notice)
            assert sorted(f[1] for f in got) == [offset + k * len(notice) for k in range(5)] and {f[0] for f in got} == {1.0}


# 8 -------------------------------------------------------------------------------------------------------------------


def test_languages_are_told(spark):
    rng = random.Random(11)
    parts = {"aa": ["ka", "lo", "mi", "ra"], "bb": ["sch", "ung", "ein", "ka"], "cc": ["ção", "ei", "ra", "ux"]}
    rows = [(i, " ".join("".join(rng.choices(parts[x], k=3)) for _ in range(rng.randint(3, 40))), x) for i in range(600) for x in [rng.choice(list(parts))]]
    docs = spark.createDataFrame([*rows, (1000, None, "aa"), (1001, "12 !", "aa")], "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 400 or doc_id >= 1000"))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert sum(got[i]["lang_pred"] == x for i, _, x in rows[400:]) >= 196
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and model.temperature > 0
    assert 0 < (model.weights != 0).mean() < 0.5
    assert langid.predict(docs, langid.Model()).select("lang_pred").distinct().collect() == [("und",)]


# 9 -------------------------------------------------------------------------------------------------------------------


def brute(rows, k):
    ok = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    return {q: sorted(((-float(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:k] for q in ok if q % 20 == 0}


def test_neighbours_among_all_rows_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)] + [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0, None] * 4), (404, [float("nan")] * 8), (405, [float("inf")] * 8), (420, [1.0, 2.0]), (440, rows[0][1]), (440, rows[0][1])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, candidates=1.0, growth=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows32 = [(i, [x if x is None else float(np.float32(x)) for x in v] if v else v) for i, v in rows]
    expect = brute(dict(rows32).items(), 20)
    assert got.keys() == {q for q, n in expect.items() if n}
    for q, near in expect.items():
        assert [i for _, i, _ in sorted(got.get(q, []))] == [i for _, i in near], q


def test_recall_in_blocks(spark):
    """The forest alone finds the neighbours: less than all rows are candidates, in one block and in several."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(6000)]
    expect = {(q, i) for q, n in brute(rows, 20).items() for _, i in n}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block_bytes in (8 << 20, 1500 * 8 * 32):
        got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(table, F.col("vec_id") % 20 == 0, block_bytes=block_bytes, query_block=100).collect()}
        assert len(got) == 6000 and len(got & expect) >= 0.9 * 6000
    points = np.array([v for _, v in rows])
    forest = ann.Forest.build(points, float(np.linalg.norm(points, axis=1).max()))
    lo, hi = forest.ascend(points[:50], 21 + ann.CANDIDATES * 6000**ann.GROWTH)
    seen = [len(np.unique(np.concatenate([o[a:b] for o, a, b in zip(forest.order, lo[:, q], hi[:, q], strict=True)]))) for q in range(50)]
    assert 0.35 * 6000 < np.mean(seen) < 0.6 * 6000


def test_slices_are_the_rows_of_a_prefix():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(400, 6))
    forest = ann.Forest.build(points, float(np.linalg.norm(points, axis=1).max()), 4)
    asked = ann.strings(np.column_stack([points[:9], np.zeros(9)]), 4)
    for level in (0, 1, 5, 32, 33):
        lo, hi = forest._slices(asked, np.full(9, level))
        for t in range(4):
            for q in range(9):
                same = [k for k in forest.keys[t].tolist() if level <= 32 and k >> (32 - level) == int(asked[t, q]) >> (32 - level)]
                assert forest.keys[t, lo[t, q] : hi[t, q]].tolist() == same


# 10 ------------------------------------------------------------------------------------------------------------------


def optimum(lengths, capacity):
    best = [len(lengths)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + lengths[k] <= capacity:
                go(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        go(k + 1, [*bins, lengths[k]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best[0]


def test_bins_are_the_fewest_on_small_cases():
    rng = random.Random(12)
    for _ in range(60):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 10))]
        plan = packing.complete_bins(dict(Counter(lengths)), 30)
        assert all(sum(p) <= 30 for p, _ in plan)
        assert Counter(x for p, m in plan for x in p * m) == Counter(lengths)
        assert sum(m for _, m in plan) == optimum(lengths, 30)


def test_bins_of_a_perfect_packing():
    rng = random.Random(15)
    for bins in (8, 15):
        for _ in range(5):
            lengths = []
            for _ in range(bins):
                a, b = rng.randint(1, 1000), rng.randint(1, 1000)
                lengths += [a, b, 2048 - a - b]
            plan = packing.complete_bins(dict(Counter(lengths)), 2048)
            assert sum(m for _, m in plan) == bins == packing.least_bins(Counter(lengths), 2048)
            assert Counter(x for p, m in plan for x in p * m) == Counter(lengths)


def test_fillings_are_all_undominated_ones():
    """Every filling by brute force is returned, or dominated by one of those returned in the sense of Martello and Toth."""
    rng = random.Random(16)

    def packs(small, large):
        """Whether the items of small fit into bins of the sizes of large."""
        if not small:
            return True
        return any(packs(small[1:], [*large[:i], x - small[0], *large[i + 1 :]]) for i, x in enumerate(large) if x >= small[0])

    for _ in range(60):
        counts = Counter(rng.randint(1, 12) for _ in range(7))
        room = rng.randint(3, 25)
        items = sorted(counts.elements(), reverse=True)
        every = {c for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room}
        got = list(packing.fillings(room, counts, room))
        assert [w for w, _ in got] == sorted(room - sum(u) for _, u in got) and {u for _, u in got} <= every and len(set(got)) == len(got)
        assert all(any(packs(list(c), list(u)) for _, u in got) for c in every)


def test_packing_round_trip(spark, awkward):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    rows = packing.pack(awkward, path).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in {r["doc_id"]: r["text"] for r in awkward.collect()}.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        copies = 2 if doc_id == 9 else 1
        assert sum(p["length"] for p in pieces[doc_id]) == len(ids) * copies
        for p in pieces[doc_id]:
            assert p["start"] == 2048 * p["piece"] and zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in group:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack(empty(spark), path).count() == 0


def test_encoding_is_the_tokenizers_own():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rng = random.Random(13)
    texts = ["".join(rng.choice(["a", "don't", "'s", " ", "\n", "İ", "Σ", "ß", "é", "12", "，", "<|endoftext|>", "\x1c", " ", "…", "_", "x" * 80]) for _ in range(30)) for _ in range(200)]
    for text, data in zip(texts, packing.encode(texts, path), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packed_ids_are_the_files_own(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    rng = random.Random(14)
    texts = ["a <|endoftext|> b", *("".join(rng.choice(["a", "don't", " ", "\n", "İ", "é", "12", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "_", "x" * 80]) for _ in range(20)) for _ in range(200))]
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    for i, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


# Brute force ---------------------------------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    """Every document against every item, window by window."""
    import os

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(9001, items[0][1]), (9002, None), (9003, "too short")]
    docs += [(9100 + k, t) for k, (_, t) in enumerate(items[:5])] + [(9200, items[5][1].replace(items[5][1].split()[6], "7"))]
    expect, D = {}, decontaminate
    made = {i: D.windows_of_item(t) for i, t in items}
    sizes = sorted({len(w[3].split(" ")) for ws in made.values() for w in ws})
    held = {}
    for i, ws in made.items():
        for w in ws:
            held.setdefault((w[0], w[3]), []).append((i, w))
    for doc_id, text in docs:
        along = {}
        for reading, position, _, window, slots in D.windows_of_document(text, sizes, lambda h: np.ones(len(h), bool)):
            for i, w in held.get((reading, window), ()):
                along.setdefault((i, position - w[1], reading), {})[w[1]] = {"position": w[1], "places": w[6], "roles": w[5], "theirs": w[4], "ours": slots, "first": w[7], "end": w[8], "rich": w[9]}
        places, alone = {}, set()
        for (i, _, reading), found in along.items():
            kept, enough = D.kept_windows(reading, list(found.values()))
            for w, exact in kept:
                for p in range(w["first"], w["end"]):
                    places.setdefault(i, {})[p] = places.get(i, {}).get(p, False) or bool(w["rich"])
                if enough:
                    alone.add(i)
        for i, got in places.items():
            every = {w[1] for w in made[i] if w[0] == D.LITERAL}
            rich = {w[1] for w in made[i] if w[0] == D.LITERAL and w[9]}
            share = max(len(got) / len(every), sum(got.values()) / len(rich) if rich else 0)
            if share >= D.COVERAGE or i in alone:
                expect[doc_id, i] = round(share, 9)
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): round(r["coverage"], 9) for r in got.collect()} == expect and len(expect) >= 7


def test_tree_equals_brute_force(spark):
    """The same cuts in memory: weighted quantiles along the widest dimension."""
    rng = random.Random(41)
    rows = [(i if i % 4 else None, "x" * int(rng.paretovariate(1.2) * 20 % 3000), rng.choice(["en", "de"]), f"s{min(3, i % 7)}", 0) for i in range(1200)]
    points = sharding.materialize(sharding.coordinates(spark.createDataFrame(rows, DOCS), "doc_id", "text", ["source", "lang"]), "points")
    leaves, dims = 13, ["c0", "c1", "c2"]
    got = {r["row"]: r["node"] for r in sharding.kd_partition(points, dims, "size", leaves).collect()}
    data = points.collect()
    expect = {}

    def split(rows, first, span):
        if span == 1:
            expect.update((r["row"], first) for r in rows)
            return
        _, _, dim = max((max(r[d] for r in rows) - min(r[d] for r in rows), -k, d) for k, d in enumerate(dims))
        goal, upto, cut = sum(r["size"] for r in rows) * (span // 2) / span, 0, None
        before, earlier = 0, None
        for r in sorted(rows, key=lambda r: r[dim]):
            before, earlier, cut = upto, cut, r[dim]
            upto += r["size"]
            if upto >= goal:
                break
        if before and goal - before < upto - goal:
            cut = earlier
        split([r for r in rows if r[dim] <= cut], first, span // 2)
        split([r for r in rows if r[dim] > cut], first + span // 2, span - span // 2)

    split(data, 0, leaves)
    assert sum(got[r] == n for r, n in expect.items()) >= 0.995 * len(expect) and set(got.values()) == set(range(leaves))


def test_toxicity_equals_plain_python(spark):
    """Counts, left-out log-odds, lambda, K and curve from lists in memory."""
    import math

    import pandas as pd
    import xxhash

    rng, T = random.Random(42), toxicity
    rows = []
    for i in range(400):
        text = prose(rng, rng.randint(20, 120)).split()
        for _ in range(3 if i % 5 == 0 else i % 37 == 0):
            text.insert(rng.randrange(len(text)), rng.choice(["zagnob", "frukels", "frukeli"]))
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    key = spark.createDataFrame([(i, xxhash.xxh3_128_digest(ngram_set(t).tobytes())) for i, t, _ in rows], "i long, k binary")
    fold = {r["i"]: r["f"] for r in key.select("i", F.pmod(F.xxhash64("k"), F.lit(T.FOLDS)).alias("f")).collect()}
    counts = [Counter() for _ in range(2 * T.FOLDS)]
    for i, t, y in rows:
        words = set(t.split())
        counts[y * T.FOLDS + fold[i]].update({f for w in words for f in T.features(w)})
        counts[y * T.FOLDS + fold[i]][""] += len(words)
    table = pd.DataFrame([{"feature": f, **{f"n{g}": c[f] for g, c in enumerate(counts)}} for f in set().union(*counts)])
    toxic, other = table[[f"n{g}" for g in range(T.FOLDS, 2 * T.FOLDS)]].sum(axis=1), table[[f"n{g}" for g in range(T.FOLDS)]].sum(axis=1)
    total = table["feature"] == ""
    share = toxic[total].sum() / other[total].sum()
    tells = np.abs(np.log((toxic + T.PRIOR) / (other * share + T.PRIOR))) >= T.TOLERANCE
    table = table[total | ((toxic >= T.LEAST_TOXIC) | (other * share >= T.LEAST_EXPECTED)) & tells]
    lexicon = T.lexicon_without(table)
    assert model.lexicon.keys() == lexicon.keys() and all(abs(model.lexicon[f] - v) < 1e-12 for f, v in lexicon.items())
    left_out = [T._TokenScores(T.lexicon_without(table, f)) for f in range(T.FOLDS)]
    scanned = [(y, *T.scan_row(left_out[fold[i]], t)) for i, t, y in rows]
    scores = np.concatenate([np.rint(s / T.CELL) * T.CELL for y, _, _, s in scanned if not y])
    lam = T.karlin_lambda(scores, np.ones(len(scores)), max(lexicon.values()) - T.DRIFT)
    k = sum(not y for y, *_ in scanned) / sum(n * math.exp(-lam * max(found, default=0.0)) for y, n, found, _ in scanned if not y)
    assert abs(model.lam - lam) < 1e-6 * lam and abs(model.k - k) < 1e-6 * k
    plain = T.Model(lexicon, lam, k)
    x = np.array([math.log1p(T.evidence(plain, n, [(0, 0, s) for s in found])[0]) for _, n, found, _ in scanned])
    plain.slope, plain.intercept = T._logistic(x, np.array([y for y, *_ in scanned], float))
    got = {r["doc_id"]: r["score"] for r in T.score(docs, model).collect()}
    T._scorers.clear()
    assert all(abs(got[i] - s) < 1e-4 for (i, _, _), (s, _, _) in zip(rows, T.score_texts([t for _, t, _ in rows], plain), strict=True))


def test_passages_equal_whole_alignment():
    """A notice anywhere in a text covers as much as the longest common subsequence with the best stretch of words around it."""
    rng = random.Random(43)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            left = 0
            for j, y in enumerate(b, 1):
                row[j], left = (left + 1 if x == y else max(row[j], row[j - 1])), row[j]
        return row[-1]

    template = [f"w{k}" for k in range(40)]
    for _ in range(60):
        notice = [w for w in template if rng.random() < rng.choice([0.7, 0.85, 1.0])]
        for _ in range(rng.randint(0, 12)):
            notice.insert(rng.randrange(len(notice) + 1), "gap")
        text = ["x"] * rng.randint(0, 130) + notice + ["y"] * rng.randint(0, 130)
        got = licenses.passages(text, np.array([w in set(template) for w in text], np.int64), template, 0.8)
        best = lcs(template, text) / 40
        assert [f[0] for f in got] == ([best] if best >= 0.8 else [])


# Awkward tables ------------------------------------------------------------------------------------------------------


def test_awkward_documents(spark, awkward):
    n = awkward.count()
    assert decontaminate.leaks(awkward, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert decontaminate.leaks(awkward, empty(spark, "item_id long, text string")).count() == 0
    classes = {r["doc_id"]: r for r in jaccard.near_duplicates(awkward).collect()}
    assert jaccard.near_duplicates(awkward).count() == n
    assert classes[8]["class_id"] == 7 and classes[8]["links"] == 1 and classes[1]["class_id"] == 1 and classes[9]["links"] == 1
    assert sharding.shard(awkward, leaves=3).count() == n
    assert licenses.scan(awkward).count() == 0
    model = langid.fit(awkward)
    assert langid.predict(awkward, model).count() == n
    assert toxicity.score(awkward, toxicity.fit(awkward, spark.createDataFrame([(1, 1), (7, 0), (None, 1), (5, None)], "doc_id long, toxic int"))).count() == n


def test_empty_tables(spark):
    none = empty(spark)
    assert jaccard.near_duplicates(none).count() == 0
    assert decontaminate.leaks(none, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert toxicity.score(none, toxicity.fit(none, empty(spark, "doc_id long, toxic int"))).count() == 0
    assert licenses.scan(none).count() == 0
    assert urlfilter.judge(empty(spark, "page_id long, url string"), queries.URL_RULES).count() == 0
    assert revisits.resolve(revisits.captures(empty(spark, "page_id long, url string, html string"))).count() == 0
    assert ann.nearest(empty(spark, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_awkward_pages_and_records(spark):
    """Repeated and tied rows, null ids and columns with names that operators use."""
    rows = [(1, "http://a.com/en/x", "<p>"), (1, "http://a.com/en/x", "<p>"), (2, None, None), (None, "http://b.org/es/", ""), (3, "http://" + "h" * 5000 + ".com/" + "p" * 50_000, "x" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("host", "path", "rule", "verdict", "canonical", "slice", "row", "revisit"):
        pages = pages.withColumn(c, F.lit("clash"))
    judged = urlfilter.judge(pages, queries.URL_RULES).collect()
    assert Counter((r["page_id"], r["verdict"]) for r in judged) == Counter({(1, "block"): 2, (2, "allow"): 1, (None, "block"): 1, (3, "allow"): 1})
    assert revisits.resolve(revisits.captures(pages.where("page_id is not null"))).count() == 4 * 2
    kind = "record_id long, url string, time long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    tied = [(1, "http://a.com/x", 5, "response", "a", None, "d1", {}), (1, "http://a.com/x", 5, "response", "a", None, "d1", {}), (2, "http://a.com/x", 5, "response", "b", None, "d2", None)] + [(3, "http://a.com/x", 5, "revisit", "b", None, None, None)] * 3
    records = spark.createDataFrame(tied, kind)
    for c in ("canonical", "slice", "row", "near", "carried", "revisit"):
        records = records.withColumn(c, F.lit(1))
    assert [(r["status"], r["response_id"], r["headers"]) for r in revisits.resolve(records).collect()] == [("resolved", 2, {})] * 3


def test_awkward_vectors(spark):
    rows = [(i if i % 3 else None, [float(i % 5), 1.0, float(i % 7)], "x") for i in range(90)] + [(20, [1.0, 2.0, 3.0], "y"), (20, [3.0, 2.0, 1.0], "y")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    for c in ("v", "q", "rep", "dim", "block", "score", "ids"):
        table = table.withColumn(c, F.lit(1))
    got = ann.nearest(table, F.col("vec_id") % 20 == 0).collect()
    assert got and all(r["vec_id"] is not None and r["vec_id"] != r["query_id"] for r in got) and {r["query_id"] for r in got} == {20, 40, 80}


def test_floods_of_rows_without_ids(spark):
    """Thousands of equal rows without an id."""
    docs = spark.createDataFrame([(None, "one two three", None, None, 0)] * 3000 + [(1, "four five", "en", "s", 0)], DOCS)
    sizes = Counter(r["shard"] for r in sharding.shard(docs, leaves=6).collect())
    assert sorted(sizes) == list(range(6)) and max(sizes.values()) - min(sizes.values()) < 40
    packed = packing.pack(docs, queries.tokenizer_path()).collect()
    assert len(packed) == 3001 and len({(r["sequence_id"], r["offset"]) for r in packed}) == 3001
    model = toxicity.fit(docs, spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).count() == 3001
    assert {(r["class_id"], r["links"]) for r in jaccard.near_duplicates(docs).collect()} == {(None, 2999), (1, 0)}
