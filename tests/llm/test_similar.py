import random
import re

import pytest

from tidewatch.llm import similar as s
from tidewatch.llm.suffixes import Hasher

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, words=3):
    w = SPLIT.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1)))


def brute(rows, words=3, percent=90):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(least.get(root(i), name), name)
    out = [(n, len(x), least.get(root(i)) if x else n) for i, ((n, _), x) in enumerate(zip(rows, sets, strict=True))]
    return sorted(out, key=repr)


def cases(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows = []

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            at = r.randrange(len(words))
            if r.random() < 0.5:
                words[at] = r.choice(vocab)
            else:
                words[at:at] = [r.choice(vocab)]
        return words

    for size in [1, 2, 3, 5, 9, 11, 12, 13, 16, 20, 21, 22, 30, 40, 60, 100, 140, 200, 333]:
        base = [r.choice(vocab) for _ in range(size)]
        rows.append(base)
        for n in (0, 0, 1, 1, 2, 3, size // 40, size // 30, size // 25):
            rows.append(edited(base, n))
            rows.append(base[: len(base) - n] or base)
        # A chain: each differs a little from the one before.
        step = base
        for _ in range(4):
            step = edited(step, max(1, size // 60))
            rows.append(step)
    r.shuffle(rows)
    out = [(i, " ".join(w).upper() if i % 7 == 0 else "\t".join(w)) for i, w in enumerate(rows)]
    return out + [(None, out[3][1]), (None, "only null"), (900, None), (901, ""), (902, " \n"), (3, out[3][1]), (3, "other text")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = cases(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, num int, key string")
    got = s.near_duplicates(df).drop("t1", "t2")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_long_lists_of_unlike_sets(spark, monkeypatch):
    # Many sets that share all but a tenth: lists are long, and few pairs link.
    r = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in r.sample(range(120), r.choice([1, 2, 3, 4])):
            words[at] = f"x{r.randrange(6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for block in (1500, 7):
        monkeypatch.setattr(s, "BLOCK", block)
        got = s.near_duplicates(df).drop("t1", "t2")
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert len({w[2] for w in want}) > 3


def test_bound_never_rules_a_link_out():
    r, hasher = random.Random(6), Hasher()
    base = [f"b{i}" for i in range(400)]
    texts = []
    for i in range(40):
        words = list(base[: r.choice([60, 200, 400])])
        for at in r.sample(range(len(words)), r.randint(0, len(words) // 20)):
            words[at] = f"x{r.randrange(9)}"
        texts.append(" ".join(words))
    sets = s.Sets(hasher, [t.encode() for t in texts])
    slot = sets.doc * s.BUCKETS + (s.mixed(sets.value) % s.U(s.BUCKETS)).astype(int)
    counts = s.np.bincount(slot, minlength=40 * s.BUCKETS).reshape(40, -1)
    i, j, apart = s.close_pairs(sets.size, s.np.arange(40), s.np.minimum(counts, 3).astype(s.np.uint8), s.np.full(40, 2))
    found, true = set(zip(i.tolist(), j.tolist(), strict=True)), set()
    for a in range(40):
        for b in range(a + 1, 40):
            x, y = shingles(texts[a]), shingles(texts[b])
            if 100 * len(x & y) >= 90 * len(x | y):
                true.add((a, b))
    assert true and true <= found
    # A forest connects what the pairs connect, with fewer of them.
    x, y = s.forest(i, j, apart, s.np.arange(40))

    def groups(pairs):
        label = list(range(40))
        for a, b in pairs:
            label = [label[a] if v == label[b] else v for v in label]
        return [label.index(v) for v in label]

    assert len(x) < 40 and groups(zip(x.tolist(), y.tolist())) == groups(found)


def listed(texts, words, percent, held=None):
    """The lists of each text; ``held`` gives a shingle's count in place of that in the texts."""
    stretch = s.Stretch(Hasher(), [t.encode() for t in texts], words, percent, 8)
    assert len(stretch.size) == len(texts)
    _, back, many = s.np.unique(stretch.sorted, return_inverse=True, return_counts=True)
    out = [set() for _ in texts]
    counts = s.level(many)[back] if held is None else held(stretch.sorted, many[back])
    for doc, key in (stretch.prefixes(counts, percent), stretch.subsets(percent)):
        for d, k in zip(doc.tolist(), key.tolist(), strict=True):
            out[d].add(k)
    return out


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_listings_are_complete(words, percent):
    """Any two linked sets share a list, whatever the order of the shingles."""
    r = random.Random(9)

    def any_order(keys, many):
        # Never 1 where two texts hold a shingle, else at will, and alike for equal shingles.
        return s.np.where(many == 1, 1, 2 + (s.mixed(keys) % s.U(90)).astype(int)).astype(s.np.uint8)

    seen = 0
    for n in [*range(1, 45), 80, 150]:
        base = [f"a{i}" for i in range(n + 2)]
        texts = {" ".join(base): None}
        for _ in range(8):
            other = list(base)
            for _ in range(r.randint(0, max(2, n // 20))):
                other[r.randrange(len(other))] = r.choice("zyx")
            if r.random() < 0.5:
                other += ["q"] * r.randint(1, 2)
            texts[" ".join(other)] = None
        texts = list(texts)
        sets = [shingles(t, words) for t in texts]
        for held in (None, any_order):
            lists = listed(texts, words, percent, held)
            for i, a in enumerate(sets):
                for j in range(i):
                    if a != sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                        seen += 1
                        assert lists[i] & lists[j], n
    assert seen > 100


def test_unlike_texts_stand_in_few_lists():
    """A passage that all texts share, and words of their own: few lists whatever their number."""
    r, passage = random.Random(7), " ".join(f"p{i}" for i in range(60))
    for many in (50, 200):
        texts = [" ".join([passage] + [f"w{r.randrange(10**6)}" for _ in range(60)]) for _ in range(many)]
        assert sum(map(len, listed(texts, 5, 80))) == 0
    assert s.level(s.np.arange(1, 10**6)).tolist() == sorted(s.level(s.np.arange(1, 10**6)).tolist())


def test_keep_one_and_empty(spark):
    rows = cases(3)
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, extra int")
    kept = s.keep_one(df).collect()
    want = brute(rows)
    assert len([k for k in kept if shingles(k.text)]) == len({w[2] for w in want if w[1]})
    assert len([k for k in kept if not shingles(k.text)]) == len([w for w in want if not w[1]])
    assert s.near_duplicates(df.limit(0)).count() == 0
    blank = df.limit(3).selectExpr("doc_id", "cast(null as string) text")
    assert s.near_duplicates(blank).where("n_shingles = 0").count() == 3


def plain_groups(rows, words, percent):
    """Smallest id of each row's group, by all pairs."""
    sets = []
    for _, t in rows:
        w = SPLIT.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (name, _), x in zip(rows, label, strict=True):
        least[x] = min(least.get(x, name), name)
    return {name: least[x] for (name, _), x in zip(rows, label, strict=True)}


@pytest.mark.parametrize(("words", "percent", "seed"), [(5, 80, 5)])
def test_other_width_and_threshold(spark, words, percent, seed):
    rows = [(k, t) for k, (_, t) in enumerate(cases(seed)) if t and t.strip()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = s.near_duplicates(df, shingle=words, percent=percent).collect()
    want = plain_groups(rows, words, percent)
    assert {r.doc_id: r.component_id for r in got} == want != plain_groups(rows, 3, 90)


def test_stage_takes_five_words_and_four_fifths(spark):
    import corpus_pipeline

    # One word replaced in the middle of 50: 41 of 51 shingles of five words, 45 of 51 of three.
    base = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:25], "x", *base[26:]])), (3, " ".join(base[:25] + ["x"] + base[26:40] + ["y"] + base[41:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, df, "").collect()}
    assert kept == set(plain_groups(rows, 5, 80).values()) == {1} != set(plain_groups(rows, 3, 90).values())
