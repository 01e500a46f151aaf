"""Groups of near-duplicates against brute force."""

import random
import re
import unicodedata

from millrace.llm import neardup as nd


def triples(text):
    w = re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text or "").lower())
    return set(zip(w, w[1:], w[2:]))


def brute(rows, least=0.7):
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(triples(t)), set()).add(i)
    own = [s for s in sets if s]
    parent = {s: s for s in own}

    def top(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for a in range(len(own)):
        for b in range(a):
            both = len(own[a] & own[b])
            if both >= least * (len(own[a]) + len(own[b]) - both):
                parent[top(own[a])] = top(own[b])
    groups = {}
    for s in own:
        groups.setdefault(top(s), set()).update(sets[s])
    return {(x, y) for g in groups.values() for x in g for y in g if x < y}


def edited(r, words, n):
    w = list(words)
    for _ in range(n):
        k = r.randrange(4)
        i = r.randrange(len(w))
        if k == 0:
            w[i] = f"new{r.randrange(999)}"
        elif k == 1:
            w.insert(i, f"ins{r.randrange(999)}")
        elif k == 2 and len(w) > 5:
            w.pop(i)
        else:
            j = r.randrange(len(w))
            w[i], w[j] = w[j], w[i]
    return w


def corpus(seed, families=60):
    r = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"w{r.randrange(400)}" for _ in range(r.randint(30, 120))]
        for v in range(r.randint(1, 5)):
            rows.append((f"id{f}-{v}", " ".join(edited(r, base, r.randrange(6)))))
    return r, rows


def test_pairs_are_those_of_brute_force(spark):
    r, rows = corpus(1)
    rows += [("copy", rows[0][1].upper() + "!"), rows[3], ("none", None), ("empty", ""), ("two", "only two"), ("two2", "only two")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "record_id string, text string, set_id int")
    got = {tuple(x) for x in nd.pairs(nd.group(df)).collect()}
    want = brute(rows)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_hot_groups_lose_no_link(spark):
    """More members of a variant than HOT: an edited family of 150 beside copies of one text."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = [(f"h{i:03d}", " ".join(edited(r, base, 1 + i % 8))) for i in range(150)] + [(f"c{i}", "one text that many have copied again and again") for i in range(200)]
    out = nd.group(spark.createDataFrame(rows, "record_id string, text string"))
    groups = {}
    for x in out.collect():
        groups.setdefault(x.group_id, set()).add(x.record_id)
    want = {}
    for a, b in brute(rows):
        want.setdefault(a, {a}).add(b)
    sizes = sorted(map(len, groups.values()))
    assert sizes[-1] == 200
    assert sum(s == 1 for s in sizes) == 350 - len({x for p in brute(rows) for x in p})


def test_links_inside_hot_variants_are_counted(spark, monkeypatch):
    """Links of a family larger than HOT, in one block and in several, are those of brute force."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = [(f"h{i:03d}", " ".join(edited(r, base, 1 + i % 8))) for i in range(90)] + corpus(2, 20)[1]
    sets = {i: triples(t) for i, t in rows}
    want = {i: sum(j != i and len(x & y) >= 0.7 * len(x | y) for j, y in sets.items()) for i, x in sets.items()}
    assert len({frozenset(x) for x in sets.values()}) == len(rows) and max(want.values()) > nd.HOT
    df = spark.createDataFrame([*rows, rows[0]], "record_id string, text string")
    for block in (256, 20):
        monkeypatch.setattr(nd, "BLOCK", block)
        got = {x.record_id: x.n_links for x in nd.group(df).collect()}
        assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.99 * sum(want.values())


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {x.node: x.group for x in nd.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    assert got == {x: top(x) for x in list(parent)}


def test_nothing(spark):
    df = spark.createDataFrame([], "record_id string, text string")
    assert nd.group(df).count() == 0 and nd.pairs(nd.group(df)).count() == 0


def chrome(n, seed=8):
    """n texts that share 60 of their 100 words and are linked with no other."""
    r = random.Random(seed)
    shared = [f"c{k}" for k in range(60)]
    return [(f"r{i}", " ".join([*shared, *(f"o{r.randrange(10**6)}" for _ in range(40))])) for i in range(n)]


def judged(spark, monkeypatch, rows, **how):
    """(rows of the result, pairs that were judged)."""
    seen, real = [], nd.verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(nd, "verified", counted)
    out = nd.group(spark.createDataFrame(rows, "record_id string, text string"), **how).collect()
    monkeypatch.setattr(nd, "verified", real)
    return out, sum(seen)


def test_shared_chrome_costs_in_proportion(spark, monkeypatch):
    """Texts that share most of their words, but not enough, don't meet in all pairs; very hot variants neither."""
    few = judged(spark, monkeypatch, chrome(600), count_links=False)
    many = judged(spark, monkeypatch, chrome(1800), count_links=False)
    monkeypatch.setattr(nd, "VERY_HOT", 2)
    assert many[1] <= 4 * few[1] < 600 * 599 / 2
    assert len({x.group_id for x in many[0]}) == 1800
    assert judged(spark, monkeypatch, chrome(1800), count_links=False)[1] <= many[1]


def test_links_between_members_that_the_first_rejects(spark, monkeypatch):
    """Pairs that are linked only with each other among many that share a hot variant are found by their rarest shingles."""
    rows = chrome(400)
    r = random.Random(2)
    twins = [(f"t{i}", " ".join(edited(r, t.split()[:60] + t.split()[60:], 1))) for i, (_, t) in enumerate(rows[:60])]
    for very in (64, 2):
        monkeypatch.setattr(nd, "VERY_HOT", very)
        got = {tuple(x) for x in nd.pairs(nd.group(spark.createDataFrame(rows + twins, "record_id string, text string"), count_links=False)).collect()}
        want = brute(rows + twins)
        assert len(want) >= 55 and got <= want and len(got) >= 0.98 * len(want)
