import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from storyloom.llm import common, decontam, jaccard
from storyloom.llm.graph import components


def slow_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h)) / (2 * len(a))


def test_alignment_scores():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(1, 12)) for _ in range(2))
        score, start, end = decontam.align(a, b)
        assert score == pytest.approx(slow_alignment(a, b)) and 0 <= start <= end <= len(b)
        assert score == 0 or slow_alignment(a, b[start:end]) == pytest.approx(score)


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(2)
    kinds = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choices(kinds, k=30))) for k in range(12)] + [(50, "tiny item"), (51, ""), (52, None), (None, "x y z")]
    docs, planted = [], set()
    for k in range(300):
        words = rng.choices(kinds, k=rng.randint(20, 200))
        if k % 10 == 0:
            item = items[rng.randrange(12)]
            copy = item[1].split()
            if k % 20 == 0:
                copy = [w if rng.random() > 0.12 else "changed" for w in copy]
            at = rng.randrange(len(words))
            words[at:at] = copy
            planted.add((k, item[0]))
        docs.append((k, " ".join(words)))
    docs += [(1000 + k, f"before {items[0][1].upper()} after") for k in range(200)]
    planted |= {(1000 + k, 0) for k in range(200)}
    docs.append((5000, "a tiny item"))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), planted | {(5000, 50)}


@pytest.mark.parametrize("chars", [decontam.BROADCAST_CHARS, 600])
def test_leaks_are_found_and_others_left_alone(leaky, chars):
    docs, items, planted = leaky
    found = decontam.leaks(docs, items, broadcast_chars=chars).collect()
    assert {(r.doc_id, r.item_id) for r in found} == planted and len(found) == len(planted)
    texts = {r.doc_id: r.text.lower().split() for r in docs.collect()}
    whole = next(r for r in found if r.doc_id == 1000)
    assert whole.score == 1 and (whole.start_word, whole.end_word) == (1, len(texts[1000]) - 1)


def test_common_short_items_are_found(spark):
    docs = spark.createDataFrame([(k, f"a{k} tiny item b{k}") for k in range(20)] + [(99, "no such thing")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "tiny item"), (2, "tiny tiny tiny tiny tiny tiny")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()} == {(k, 1) for k in range(20)}


def test_items_and_documents_have_one_normal_form(spark):
    pairs = ["ΟΔΥΣΣΕΥΣ ΚΑΙ ΟΙ ΛΟΓΟΣ ΣΟΦΙΑΣ", "İstanbul büyük İzmir küçük şehir", "Straße: “die” (große), ist... lang!"]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(pairs)], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in enumerate(pairs)] + [(9, "x straße, die große ist lang; y")], "doc_id bigint, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(docs, items).collect()}
    assert found == {(0, 0): 1, (1, 1): 1, (2, 2): 1, (9, 2): 1}


def test_long_items_common_seeds_and_shared_ids(spark):
    rng = random.Random(4)
    long = " ".join(f"v{rng.randrange(9000)}" for _ in range(600))
    items = spark.createDataFrame([(1, long), (2, "of the very same kind now here it ends"), (3, "some other item of five words"), (3, "the second text of that id here")], "item_id bigint, text string")
    docs = [(k, f"a{k} of the very same kind b{k}") for k in range(60)]
    docs += [(100, "x " + long), (101, "of the very same kind now here it ends"), (102, "nothing here"), (102, "some other item of five words"), (103, "the second text of that id here")]
    for chars in (100, decontam.BROADCAST_CHARS):
        found = decontam.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items, broadcast_chars=chars).collect()
        whole = {(r.doc_id, r.item_id) for r in found if r.score == 1}
        assert whole == {(100, 1), (101, 2), (102, 3), (103, 3)} and len(found) == len({(r.doc_id, r.item_id) for r in found})
        assert {(r.doc_id, r.item_id) for r in found} - whole == {(k, 2) for k in range(60)}  # two common seeds, and half the words


def test_leaks_by_a_key_of_each_row(spark):
    docs = spark.createDataFrame([(None, "a tiny item"), (1, "a tiny item"), (1, "other")], "doc_id bigint, text string")
    keyed = common.row_keyed(docs)
    found = decontam.leaks(keyed, spark.createDataFrame([(50, "tiny item")], "item_id bigint, text string"), id_col="__row")
    assert found.count() == 2
    assert [r.text for r in keyed.join(found, "__row", "left_anti").collect()] == ["other"]


def test_leaks_of_odd_tables(odd, empty, leaky):
    docs, items, _ = leaky
    assert decontam.leaks(empty, items).count() == 0
    assert decontam.leaks(docs, items.limit(0)).count() == 0
    assert decontam.leaks(odd, items).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def brute_force(rows):
    sets = [frozenset(zip(*[w[j:] for j in range(5)], strict=False)) if len(w := (t or "").encode().split()) >= 5 else frozenset([tuple(w)] if w else []) for _, t in rows]
    links, root = Counter(), list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)].append(i)
    return Counter((i, min(least[top(k)]) if least[top(k)] else None, links[k]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("block", "grams"), [(jaccard.BLOCK, jaccard.BLOCK_GRAMS), (5, jaccard.BLOCK_GRAMS), (50, 700)])
def test_links_and_classes(spark, block, grams):
    rng = random.Random(9)
    kinds = [f"w{k}" for k in range(5000)]
    rows = []
    for group in range(12):
        base = rng.choices(kinds, k=rng.choice((6, 60, 300)))
        for _ in range(rng.choice((1, 2, 25))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(kinds)
            rows.append((len(rows), " ".join(copy[: len(copy) - rng.choice((0, 0, 1, len(copy) // 12))])))
    rows += [(900 + k, "the same text in very many rows of it") for k in range(40)]
    rows += [(950, None), (951, ""), (952, " \n"), (953, "two words"), (954, "two  words"), (955, "one")]
    rng.shuffle(rows)
    found = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"), block=block, grams=grams).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == brute_force(rows)


def test_links_of_odd_tables(odd, empty):
    assert jaccard.join(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = jaccard.join(odd).collect()
    wanted = brute_force(rows)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == wanted


def test_rows_without_an_id_link_like_others(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (None, " ".join([*words, "more"])), (None, "only here " * 4), (None, "only here " * 4), (2, ""), (2, "")]
    found = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"), carry=("text",)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == brute_force(rows)
    by = {r.text: r for r in found}
    assert by[rows[0][1]].class_key == by[rows[1][1]].class_key != by[rows[2][1]].class_key
    assert by[rows[1][1]].n_links == 1 and by[""].class_key is None


@pytest.mark.parametrize("hot", [1, 4, 1 << 15])
def test_rows_find_the_row_of_their_key(spark, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rows = spark.range(100).select(F.when(F.col("id") < 60, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    per_key = rows.groupBy("k").agg(F.max("id").alias("most"), F.count("*").alias("n"))
    found = common.join_back(rows, per_key, "k", "n", 100)
    assert sorted(found.columns) == ["id", "k", "most"]
    most = {k: max(r.id for r in rows.collect() if r.k == k) for k in range(7)}
    assert sorted((r.id, r.most) for r in found.collect()) == [(r.id, most[r.k]) for r in rows.collect()]


def test_bands_reach_the_recall():
    bands, rows = jaccard.bands_and_rows(0.8, 0.9999)
    assert (1 - 0.8**rows) ** bands <= 0.0001 < (1 - 0.8**rows) ** (bands - 1)


def test_items_of_one_id_in_two_parts_give_one_row(spark):
    """Two rows of an id, each in a part of its own: the better place of the pair is told, once."""
    first, second = " ".join(f"a{k}" for k in range(12)), " ".join(f"b{k}" for k in range(12))
    docs = spark.createDataFrame([(7, f"x y {first} z {' '.join(second.split()[:9])} q")], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, first), (1, second), (1, second)], "item_id bigint, text string")
    found = decontam.leaks(docs, benchmark, broadcast_chars=20).collect()
    assert [(r.doc_id, r.item_id, r.score, r.start_word, r.end_word) for r in found] == [(7, 1, 1.0, 2, 14)]


def test_benchmark_texts_do_not_meet_in_one_task(spark):
    """Only ids, marks and lengths are put in one order."""
    import contextlib
    import io

    seen = []
    kept = decontam.materialize
    benchmark = spark.createDataFrame([(1, "a b c d e")], "item_id bigint, text string")
    try:
        decontam.materialize = lambda df, name: (seen.append((name, df)), kept(df, name))[1]
        decontam.leaks(spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string"), benchmark).count()
    finally:
        decontam.materialize = kept
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        dict(seen)["parts"].explain("simple")
    one = plan.getvalue().split("SinglePartition")
    assert len(one) == 2 and "text#" not in one[0]


def test_edited_copies_of_items_are_found(spark):
    """Copies with 5 to 30 % of their words changed, dropped or joined by others: nine of ten at least that align by half."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    items = [(k, [rng.choice(words) for _ in range(rng.randrange(16, 60))]) for k in range(30)]
    rows, wanted = [], set()
    for share in (0.05, 0.1, 0.2, 0.3):
        for k, item in items:
            text = [rng.choice(words) for _ in range(rng.randrange(150))]
            for w in item:
                kind = rng.random()
                text += [rng.choice(words)] if kind < share * 0.6 else [] if kind < share * 0.8 else [w, rng.choice(words)] if kind < share else [w]
            text += [rng.choice(words) for _ in range(rng.randrange(150))]
            rows.append((len(rows), " ".join(text)))
            if decontam.align(item, text)[0] >= decontam.MIN_SCORE:
                wanted.add((rows[-1][0], k))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, benchmark).collect()}
    assert len(wanted) > 100 and len(found & wanted) >= 0.95 * len(wanted)


def test_repeated_rows_are_read_once(spark, monkeypatch):
    """Twenty thousand rows of one text and no id: one of them goes into the comparison."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = spark.range(20_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(text).alias("text"))
    docs = rows.unionAll(spark.createDataFrame([(5, text + " more")], "doc_id bigint, text string"))
    seen, kept = [], jaccard.map_text
    monkeypatch.setattr(jaccard, "map_text", lambda df, *a, **k: (seen.append(df), kept(df, *a, **k))[1])
    monkeypatch.setattr(jaccard, "release", lambda *a: None)
    found = {(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in jaccard.join(docs).collect()}
    assert found == {(None, 5, 20_000, 20_000), (5, 5, 20_000, 1)}
    assert seen[-1].count() == 2
