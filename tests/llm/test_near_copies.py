"""The pipeline's near-duplicate stage against all pairs by brute force."""

import random

import corpus_pipeline
from marketlens.llm import near_copies, simhash


def _shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _copies(rng):
    """Families of copies with more and more words changed, under one common line, with odd rows between."""
    line = [f"line{i}" for i in range(12)]
    for family in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([20, 120, 300]))]
        for edits in range(8):
            words = list(base)
            for at in rng.sample(range(len(words)), edits * len(words) // 150):
                words[at] = f"new{rng.randrange(10**6)}"
            yield " ".join(words + line * (family % 2))
    yield from ("three words only", "Three  words only", "", None, "word")


def test_links_are_those_of_all_pairs(spark):
    texts = list(_copies(random.Random(5)))
    rows = [(i + 1, x) for i, x in enumerate(texts)] + [(None, texts[0])]
    sets = {i: _shingles(x) for i, x in rows if i}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    far = 0
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
                far += (simhash.fingerprint(texts[a - 1].encode()) ^ simhash.fingerprint(texts[b - 1].encode())).bit_count() > 4
    assert far > 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, *(i for i in sets if find(i) == i)]


def test_a_group_that_nearly_links_makes_few_pairs(spark, monkeypatch):
    """Copies with too many edits to link: a pair is made once, and only if it may link by the parity bits."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(4000)}" for _ in range(200)]
    texts = []
    for _ in range(120):
        words = list(base)
        for at in rng.sample(range(len(words)), 4):
            words[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    made, checked = [], near_copies._checked

    def counted(pairs, sets, rows, name):
        if name == "copies-across":
            made.append((pairs.count(), pairs.distinct().count()))
        return checked(pairs, sets, rows, name)

    monkeypatch.setattr(near_copies, "_checked", counted)
    links = near_copies.near_links(spark.createDataFrame([(i, x.encode()) for i, x in enumerate(texts)], "node long, t binary"))
    linked = {(r.a, r.b) for r in links.collect()}
    sets = [_shingles(x) for x in texts]
    near = {(i, j) for i in range(120) for j in range(i + 1, 120) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert linked <= near
    root = near_copies_roots(near), near_copies_roots(linked)
    assert root[0] == root[1]
    assert made[0][0] == made[0][1] < 120 * 119 / 2 / 4


def near_copies_roots(links):
    root = list(range(120))
    for _ in range(120):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_a_group_whose_rows_link_but_not_to_the_first_makes_few_pairs(spark, monkeypatch):
    """Copies of which each links to some others: components are brought together before pairs across them are made."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(4000)}" for _ in range(200)]
    texts = []
    for _ in range(120):
        words = list(base)
        for at in rng.sample(range(10, 200, 19), 3):
            words[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    made, checked = [], near_copies._checked

    def counted(pairs, sets, rows, name):
        made.append((name, pairs.distinct().count()))
        return checked(pairs, sets, rows, name)

    monkeypatch.setattr(near_copies, "_checked", counted)
    monkeypatch.setattr(near_copies, "HOOKED", 16, raising=False)
    links = near_copies.near_links(spark.createDataFrame([(i, x.encode()) for i, x in enumerate(texts)], "node long, t binary"))
    sets = [_shingles(x) for x in texts]
    near = {(i, j) for i in range(120) for j in range(i + 1, 120) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    linked = {(r.a, r.b) for r in links.collect()}
    assert linked <= near and near_copies_roots(near) == near_copies_roots(linked)
    assert sum(n for name, n in made if name != "copies-star") < 2 * 120 < len(near) / 2
