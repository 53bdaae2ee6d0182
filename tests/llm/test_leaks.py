import random
import time

from newsloom.llm import leaks

ITEM = "The trustee for Vane reckons that unsecured revenue, at 951.1 per unit, will not cover the receipt held by Orlo; growers had priced it lower before it eased."
SCHEMA = "doc_id bigint, text string, source string, item_id string"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "s", "clash") for k, t in enumerate(texts)], SCHEMA)


def items(spark, texts):
    return spark.createDataFrame([(100 + k, "q", t) for k, t in enumerate(texts)], "item_id bigint, suite string, item_text string")


def found(spark, texts, tests):
    return {(r.doc_id, r.item_id): r.n_words for r in leaks.leaks(docs(spark, texts), items(spark, tests)).collect()}


def test_disguises(spark):
    w = ITEM.split()
    twelve = " ".join(leaks.words(ITEM)[3:15])
    hidden = "".join(c + ("​" if k % 9 == 4 else "­" if k % 9 == 7 else "") for k, c in enumerate(ITEM))
    texts = [
        f"before {ITEM} after", ITEM.upper(), ITEM.replace(" ", "&nbsp;"), " ".join(f"<b>{x}</b>" if k % 3 else f'<span class="x">{x}</span><br/>' for k, x in enumerate(w)), hidden, "> " + "\n> ".join(w),
        ITEM.replace("unsecured", "unse-\ncured"), ITEM.replace("receipt", "re-\r\n> ceipt"), ITEM.replace(" ", "  \t"), "ｔｈｅ　" + ITEM[4:], f"x {twelve} y", " ".join(leaks.words(ITEM)[3:14]), None, "", "   ",
        " ".join(x if k % 8 else "other" for k, x in enumerate(leaks.words(ITEM))), ITEM,
    ]
    got = found(spark, texts, [ITEM])
    assert {d for d, _ in got} == {0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 16}
    assert got[10, 100] == 12 and got[0, 100] == len(leaks.words(ITEM))


def brute(texts, tests):
    out = {}
    for i, t in enumerate(tests):
        tw = leaks.words(t)
        for d, x in enumerate(texts):
            dw = leaks.words(x)
            best = 0
            for p in range(len(dw)):
                for q in range(len(tw)):
                    n = 0
                    while p + n < len(dw) and q + n < len(tw) and dw[p + n] == tw[q + n]:
                        n += 1
                    best = max(best, n)
            if best >= leaks.LENGTH:
                out[d, 100 + i] = best
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = "a b c d".split()
    tests = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 14, 30]))) for _ in range(8)]
    texts = []
    for _ in range(60):
        ws = [rng.choice(vocabulary + ["z"]) for _ in range(rng.choice([0, 10, 40]))]
        t = rng.choice(tests).split()
        k = rng.randrange(len(t))
        texts.append(" ".join(ws[: len(ws) // 2] + t[k : k + rng.choice([8, 12, 13, 40])] + ws[len(ws) // 2 :]))
    assert found(spark, texts, tests) == brute(texts, tests)


def test_shards_and_blocks(spark, monkeypatch):
    texts = [f"{k} {ITEM}" if k % 3 == 0 else "plain words of no test" for k in range(30)]
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 1)
    got = found(spark, texts, [ITEM, "short", None, ITEM])
    assert set(got) == {(k, i) for k in range(0, 30, 3) for i in (100, 103)}


def test_reports_and_empty(spark):
    d, i = docs(spark, [ITEM, "x", ITEM]), items(spark, [ITEM, "short"])
    assert {r.item_id: (r.n_docs, r.longest > 12) for r in leaks.leak_report(d, i).collect()} == {100: (2, True), 101: (0, False)}
    assert [r.doc_id for r in leaks.without_leaks(d, i).collect()] == [1]
    assert found(spark, [], [ITEM]) == {} and found(spark, [ITEM], []) == {}


def test_long_text(spark):
    assert set(found(spark, ["word " * 200_000 + ITEM, "a " * 300_000], [ITEM, "a " * 500])) == {(0, 100), (1, 101)}


def test_markup_of_any_length(spark):
    half = ITEM.index("will not")
    long = "x" * 3000
    texts = [
        f'{ITEM[:half]}<img src="data:image/png;base64,{long}"/> {ITEM[half:]}',
        f'{ITEM[:half]}<a href="https://v.example/?{long}">{ITEM[half:]}</a>',
        f"{ITEM[:half]}<!-- {'note <b>on</b> style ' * 200} -->{ITEM[half:]}",
        f"a stray <!-- here, then {ITEM} {'and more ' * 100} --> there",
        f"{ITEM[:half]}<!-- never closed {ITEM[half:]}",
    ]
    got = found(spark, texts, [ITEM])
    assert {d for d, _ in got} >= {0, 1, 2, 3} and len({got[k, 100] for k in range(4)}) == 1


def test_much_open_markup_is_read_in_linear_time():
    began = time.process_time()
    for text in ("<!--" * 200_000, "<a " * 300_000, "<a " + "b" * 1_000_000, "<!-- --" * 100_000, "<b><!--->" * 50_000):
        leaks.words(text, {})
    assert time.process_time() - began < 20


def test_suffix_ranks_sort_the_suffixes():
    rng = random.Random(2)
    for _ in range(60):
        line = leaks.np.array([rng.choice([0, 1, 1, 2, 3]) if rng.random() < 0.9 else 0 for _ in range(rng.randint(1, 60))])
        runs = leaks.run_lengths(line)
        at = leaks.np.flatnonzero(line)
        s = leaks.Suffixes(line, at, runs, 64)
        text = {int(p): tuple(line[p : p + runs[p]].tolist()) for p in at}
        assert sorted(at.tolist(), key=lambda p: (s.order()[p], p)) == sorted(at.tolist(), key=lambda p: (text[p], p))
        for _ in range(20 if len(at) else 0):
            p, q = rng.choice(at.tolist()), rng.choice(at.tolist())
            n = next((k for k, (a, b) in enumerate(zip(text[p], text[q])) if a != b), min(len(text[p]), len(text[q])))
            assert s.common(leaks.np.array([p]), leaks.np.array([q])).tolist() == [n]


def test_long_matches_of_repetitive_texts_against_brute_force():
    rng = random.Random(12)
    for _ in range(40):
        tests = [" ".join(rng.choice("ab") for _ in range(rng.choice([12, 20, 70]))) for _ in range(3)] + ["a " * 40]
        texts = [" ".join(rng.choice("abz" if rng.random() < 0.1 else "ab") for _ in range(rng.choice([0, 13, 120]))) for _ in range(4)] + ["a " * 55]
        t = leaks.Tests([(100 + k, x) for k, x in enumerate(tests)])
        docs = [(k, 0, [t.vocabulary.get(w, 0) for w in leaks.words(x, t.vocabulary)]) for k, x in enumerate(texts)]
        doc, item, n, p, q = leaks.search(t, docs)
        assert {(d, i): m for d, i, m in zip(doc.tolist(), item.tolist(), n.tolist())} == brute(texts, tests)
        for d, i, m, a, b in zip(doc, item, n, p, q):
            assert leaks.words(texts[d])[a : a + m] == leaks.words(tests[i - 100])[b : b + m]


def test_boilerplate_takes_no_product_of_places():
    """Half a million equal words against items of many equal words."""
    began = time.process_time()
    t = leaks.Tests([(k, "word " * 2000) for k in range(20)])
    doc, item, n, *_ = leaks.search(t, [(k, 0, [1] * 100_000) for k in range(5)])
    assert len(doc) == 100 and set(n.tolist()) == {2000} and time.process_time() - began < 60


def test_parts_of_a_long_document(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SHARD_WORDS", 50)
    n = len(leaks.words(ITEM))
    texts = [("x " * k) + ITEM + (" y" * (200 - k)) for k in range(20, 90, 3)] + [ITEM]
    t = leaks.Tests([(100, ITEM)])
    run = leaks._find([type("B", (), {"value": t})()])
    import pyarrow as pa

    out = [r for b in run(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])])) for r in b.to_pylist()]
    best = {}
    for r in out:
        best[r["doc_id"]] = max(best.get(r["doc_id"], (0, 0)), (r["n_words"], r["doc_word"]))
    assert best == {k: (n, 20 + 3 * k) for k in range(len(texts) - 1)} | {len(texts) - 1: (n, 0)}
