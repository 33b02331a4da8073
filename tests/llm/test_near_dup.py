"""Near-duplicates against brute force."""

import random
import re

import pytest

from bandscan.llm import components as components_of
from bandscan.llm import near_dup
from bandscan.llm.near_dup import missed, near_duplicates


def brute(rows, size=5, percent=75):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    top = {i: i for i, _ in rows}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = root(rows[a][0]), root(rows[b][0])
                top[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), root(i) == i) for (i, _), s in zip(rows, sets))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cde fgh ij klm nop qr stu vw xyz Aé ñu".split()) + rng.choice("abcdefgh")
    texts = [None, "", "  \n\t", "one two", "one two", "Four words are few"]
    line = " ".join(word() for _ in range(12))
    for _ in range(25):
        base = [word() for _ in range(rng.randint(5, 90))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            near = list(base)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near))
        if rng.random() < 0.5:
            texts.append(" ".join([*(word() for _ in range(9)), line, *(word() for _ in range(9))]))
    base = [word() for _ in range(300)]
    for k in range(60):
        near = list(base)
        near[5 * k] = f"own{k}"
        texts.append(" ".join(near))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,bound", [(1, 2000), (2, 6)])
def test_components_match_brute_force(spark, seed, bound):
    rows = corpus(seed)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bound=bound)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_empty_null_and_repeated(spark):
    empty = near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f"), (7, None)]
    got = near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, comp int"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False), (None, 2, None, True), (7, 0, 7, True)], key=str)


def test_single_links_in_a_family_just_below(spark):
    """Members share 0.66 to 0.74 with nearly all others; pairs with four edits at equal places share 0.76."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(1100):
        near = list(base)
        for slot in rng.sample(range(59), 6):
            near[5 * slot + 4] = f"own{i}x{slot}"
        rows.append((i, " ".join(near)))
    want = brute(rows)
    assert sum(not kept for *_, kept in want) > 100
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == want


def tight_family(members, partners):
    """Documents that share 84 % of their shingles (0.724 to each other), some with a partner at 0.7513."""
    base = " ".join(f"w{k}" for k in range(424))
    rows = [(i, " ".join([base, *(f"o{i}x{k}" for k in range(80))])) for i in range(members)]
    for i in range(partners):
        rows.append((members + i, " ".join([base, *(f"o{i}x{k}" for k in range(9)), *(f"p{i}x{k}" for k in range(71))])))
    return rows


@pytest.mark.parametrize("members,bound", [(2000, 2000), (3000, 2000)])
def test_recall_in_a_tight_family(spark, members, bound):
    """By construction each partner is linked with its document, and nothing else is linked."""
    rows = tight_family(members, 200)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), bound=bound).collect()
    comp = {r["doc_id"]: r["component_id"] for r in got}
    found = sum(comp[members + i] == i for i in range(200)) / 200
    print("recall", members, found)
    assert found >= 0.98
    assert sum(comp[i] == i for i in range(members)) == members


def test_a_hot_family_of_near_copies(spark):
    """One family larger than a leaf, its members linked by a few pivots, beside single documents."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(900):
        near = list(base)
        for slot in rng.sample(range(39), rng.randint(0, 5)):
            near[5 * slot + 4] = f"own{i}x{slot}"
        rows.append((i, " ".join(near)))
    rows += [(i, " ".join(f"s{i}x{k}" for k in range(50)) + " common line of many words that all hold") for i in range(900, 1200)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bound=100)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_levels_below_the_roots_are_not_joined_with_their_nodes(spark, monkeypatch):
    """Only the root nodes' members are: a join a level made a large group's rows anew at each."""
    plans, leaves = [], near_dup._leaves
    monkeypatch.setattr(near_dup, "_leaves", lambda members, *a, **k: plans.append(members._jdf.queryExecution().analyzed().toString()) or leaves(members, *a, **k))
    near_duplicates(spark.createDataFrame(tight_family(60, 0), "doc_id long, text string"), bound=10, depth=1)
    # the roots' nodes, and what is known of each member
    assert "LeftAnti" in plans[-1] and plans[-1].count("Join Inner") == 2


def test_documents_meet_their_components_once(spark, monkeypatch):
    """Not once for each tree, node or group: a join on id makes one row an id."""
    seen, labelled = [], near_dup._Links.labelled
    monkeypatch.setattr(near_dup._Links, "labelled", lambda self, rows: seen.append(rows.groupBy("id").count().agg({"count": "max"}).first()[0]) or labelled(self, rows))
    near_duplicates(spark.createDataFrame(tight_family(60, 20), "doc_id long, text string"), bound=10, depth=1)
    assert set(seen) - {None} == {1}  # None: no rows


def test_random_deals_do_not_grow_with_trees_and_levels(spark, monkeypatch):
    """A document is dealt a fixed number of times a level, not twice for each of its large nodes, of which a large group has more at each level."""
    dealt, leaves = [], near_dup._leaves

    def seen(members, kind, dense=True):
        if not dense:
            dealt.append(members.groupBy("id").count().agg({"count": "max"}).first()[0])
        return leaves(members, kind, dense)

    monkeypatch.setattr(near_dup, "_leaves", seen)
    got = near_duplicates(spark.createDataFrame(tight_family(60, 20), "doc_id long, text string"), bound=10, depth=2).collect()
    assert len(dealt) == 3 and max(x for x in dealt if x) <= 6
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, i - 60 if i >= 60 else i) for i in range(80)]


def test_few_members_beside_a_large_component_end_a_node(spark):
    """Each of them meets all members in leaves, and the large component's members one leaf each; a node with more of them stays open."""
    rows = [(1, i, 0 if i < 90 else i) for i in range(100)] + [(2, i, 0 if i < 10 else i) for i in range(100)] + [(3, i, 0) for i in range(100)]
    labelled = spark.createDataFrame(rows, "path long, id long, comp long")
    closing = near_dup._closing(labelled, 40)
    assert sorted((r["path"], r["top"], r["rest"]) for r in closing.collect()) == [(1, 0, 10), (3, 0, 0)]
    leaves = {}
    for path, i in near_dup._closed(labelled, closing).collect():
        leaves.setdefault(path, []).append(i)
    met = {(a, b) for x in leaves.values() for a in x for b in x if a < b}
    assert met >= {(a, b) for b in range(90, 100) for a in range(b)}
    assert sum(map(len, leaves.values())) == 90 + 10 * len(leaves) and 2 <= len(leaves) <= 5


def test_components_by_driver_and_by_rounds(spark, monkeypatch, tmp_path):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(500, 560)]
    links = spark.createDataFrame([tuple(sorted(x)) for x in links if x[0] != x[1]], "a long, b long").cache()
    here = sorted(map(tuple, components_of.components(links, f"file://{tmp_path}/a").collect()))
    monkeypatch.setattr(components_of, "FEW_LINKS", 0)
    assert here == sorted(map(tuple, components_of.components(links, f"file://{tmp_path}/b").collect()))


def test_regular_words_do_not_collide(spark):
    """The Thue-Morse word over a and b and its complement, whose polynomial hashes modulo 2^64 are equal."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba")))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, True), (2, 1, 2, True)]


def test_equal_ids_with_different_texts_and_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, "a b c d e f g"), (1, "k l m n o p q"), (2, "k l m n o p q"), (3, long), (4, long + " end")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got.collect()) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False)]


def test_computed_miss():
    assert missed(0) < 1e-7 and missed(10) < 5e-5
