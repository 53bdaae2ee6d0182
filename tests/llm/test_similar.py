import random
import re
from datetime import datetime

from newsloom.llm import similar


def article(key, headline, summary=None, at=1, source="a"):
    return {"dedupe_key": key, "source_api": source, "headline": headline, "summary": summary, "ingested_at": datetime(2024, 7, at)}


def words(r):
    return set(re.findall(r"[^\W_]+", f"{r['headline'] or ''} {r['summary'] or ''}".lower()))


def brute(rows):
    first = {}
    for r in sorted(rows, key=lambda r: r["ingested_at"]):
        first.setdefault(r["dedupe_key"], r)
    keys = sorted(k for k in first if k is not None and words(first[k]))
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = words(first[a]), words(first[b])
            if len(x & y) >= 0.6 * len(x | y):
                out.add((a, b))
    return out


def pairs(df):
    return [(r.dedupe_key_a, r.dedupe_key_b) for r in similar.similar_pairs(df).collect()]


def corpus(seed, stories=40):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    common = [f"c{k}" for k in range(40)]
    rows = []
    for s in range(stories):
        base = rng.sample(vocabulary, 35) + rng.sample(common, 15)
        for v in range(rng.choice([1, 2, 3, 4])):
            ws = [w if rng.random() > 0.08 * v else rng.choice(vocabulary) for w in base]
            rng.shuffle(ws)
            rows.append(article(f"k{s:03}-{v}", " ".join(ws[:12]), ". ".join(ws[12:])))
    return rows


def test_against_brute_force(make_articles):
    rows = corpus(1)
    rows += [dict(rows[0], dedupe_key="copy1"), dict(rows[0], dedupe_key="copy2", headline=rows[0]["headline"].upper())]
    want = brute(rows)
    got = pairs(make_articles(rows))
    assert len(got) == len(set(got))
    assert set(got) == want


def test_odd_rows(make_articles):
    rows = [
        article("a", "One two three four five"),
        article("b", "ONE, two; three-four FIVE!", ""),
        article("b", "nothing alike at all here", at=2),
        article("c", None, "one two three four five six"),
        article("d", None, None), article("e", "", ""), article("f", "...", None),
        article(None, "one two three four five"),
        article("a", "One two three four five"),
    ]
    assert set(pairs(make_articles(rows))) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert pairs(make_articles([])) == []


def test_many_copies_are_one_class(make_articles):
    rows = [article(f"k{n:03}", "the very same words in every one of them") for n in range(120)]
    assert len(pairs(make_articles(rows))) == 120 * 119 // 2
    s = similar.stories(make_articles(rows)).collect()
    assert len({r.class_id for r in s}) == 1 and all(r.n_links == 0 for r in s)


def test_stories_are_components(make_articles):
    rows = corpus(5, 20)
    got = {r.dedupe_key: r.story_id for r in similar.stories(make_articles(rows)).collect()}
    root = {k: k for k in got}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs(make_articles(rows)):
        root[find(a)] = find(b)
    assert len(got) == len(rows)
    groups = {}
    for k, s in got.items():
        groups.setdefault(s, set()).add(find(k))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({find(k) for k in got})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001), (1001, 1000), (5, 5)], "u bigint, v bigint")
    got = {r.node: r.root for r in similar.components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {1000: 1000, 1001: 1000}


def templated(seed, stories=60):
    """Texts of few templates: similar ones share common words, and their rare words differ."""
    rng = random.Random(seed)
    forms = [[f"t{f}x{k}" for k in range(36)] for f in range(3)]
    rows = []
    for s in range(stories):
        ws = [w for w in forms[s % 3] if rng.random() > 0.06] + [f"r{rng.randrange(10**6)}" for _ in range(rng.choice([2, 5, 8, 11]))]
        rng.shuffle(ws)
        rows.append(article(f"k{s:03}", " ".join(ws[:9]), " ".join(ws[9:])))
    return rows


def test_no_pair_is_lost_where_rare_words_differ(make_articles):
    rows = templated(3) + corpus(4, 20)
    want = brute(rows)
    assert len(want) > 300 and set(pairs(make_articles(rows))) == want


def test_words_split_over_blocks_meet_all_the_same(make_articles, monkeypatch):
    rows = templated(6, 30)
    want = brute(rows)
    monkeypatch.setattr(similar, "BLOCK", 7)
    monkeypatch.setattr(similar, "TILE", (3, 5))
    counts = similar.np.full(similar.BUCKETS, 20)
    words_of = {r["dedupe_key"]: similar.word_hashes(r["headline"], r["summary"]) for r in rows}
    batch = similar.pa.RecordBatch.from_arrays(
        [similar.pa.array(range(len(rows)), similar.pa.int64()), similar.pa.array([similar.np.sort(w.astype("uint32")).view("int32") for w in words_of.values()])], names=["cid", "words"]
    )
    shared = type("Shared", (), {"value": counts})
    laid = similar.pa.Table.from_batches(similar._prefixes(shared, 0.6)([batch])).sort_by("key")
    assert len({k & 3 for k in laid["key"].to_pylist()}) == 3
    keys = list(words_of)
    met = {(keys[a], keys[b]) for out in similar._meetings(0.6)(laid.to_batches(max_chunksize=11)) for a, b in zip(*(c.to_pylist() for c in out.columns))}
    assert want <= met


def of_one_word(rows):
    """Rows of one word in one block: classes of 50 words whose bitmaps all agree; those after the first few only pass by."""
    np = similar.np
    maps = [np.zeros(rows, np.int64) for _ in range(similar.BITS // 64)]
    role = np.where(np.arange(rows) < 2000, similar.PROBE | similar.INDEX, similar.INDEX)
    columns = [np.zeros(rows, np.int64), np.arange(rows), role.astype(np.int32), np.full(rows, 50, np.int32), *maps]
    return similar.pa.Table.from_arrays([similar.pa.array(c) for c in columns], names=[c.split()[0] for c in similar.PREFIX.split(", ")])


def test_memory_of_a_word_that_many_texts_share():
    import tracemalloc

    laid, held = of_one_word(6000), 2000
    tracemalloc.start()
    n = largest = 0
    for out in similar._meetings(0.6)(iter(laid.to_batches(max_chunksize=1000))):
        n, largest = n + out.num_rows, max(largest, out.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == held * (held - 1) + held * (6000 - held)  # nothing is lost
    assert largest < 1_000_000 and peak < 150e6


def test_layout_of_a_word_in_many_blocks_comes_in_parts(monkeypatch):
    np = similar.np
    monkeypatch.setattr(similar, "BLOCK", 10)
    words = [np.array([k, 9000 + k], np.uint32).view(np.int32) for k in range(1000)]
    batch = similar.pa.RecordBatch.from_arrays([similar.pa.array(range(1000), similar.pa.int64()), similar.pa.array(words, similar.pa.list_(similar.pa.int32()))], names=["cid", "words"])
    shared = type("Shared", (), {"value": np.full(similar.BUCKETS, 20_000)})
    sizes = [b.num_rows for b in similar._prefixes(shared, 0.6)(iter([batch]))]
    assert sum(sizes) == 1000 * 2001 and max(sizes) < 200_000


def test_copies_do_not_split_a_word(make_articles, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 10)
    rows = [article(f"k{n}", f"shared own{n % 3}") for n in range(30)]
    text = make_articles(rows).select("dedupe_key", "ingested_at", "headline", "summary")
    counts = similar.word_counts(text.mapInArrow(similar._described, "dedupe_key string, ingested_at timestamp_ntz, cid bigint, words array<int>"))
    assert 2 <= counts.max() <= 9  # 3 classes and no more than one block, where 30 texts would make 4


def test_pairs_with_copies_of_frequent_words(make_articles, monkeypatch):
    rows = templated(8, 30)
    rows += [dict(r, dedupe_key=f"{r['dedupe_key']}-{c}") for r in rows for c in range(2)]
    monkeypatch.setattr(similar, "BLOCK", 5)
    assert set(pairs(make_articles(rows))) == brute(rows)
