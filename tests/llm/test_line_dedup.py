import random
from itertools import combinations

import numpy as np

from twinbill.llm.line_dedup import LineDedup, _heaviest, line_dedup, patience, runs


def _longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_patience_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randint(0, 12) for _ in range(rng.randint(0, 20))]
        b = [rng.randint(0, 12) for _ in range(rng.randint(0, 20))]
        found = patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
        assert len(found) <= _longest_common(a, b)
        distinct = rng.sample(range(100), 20)
        other = [x for x in distinct if rng.random() < 0.7] + rng.sample(range(200, 300), 3)
        assert len(patience(distinct, other)) == _longest_common(distinct, other)
    assert patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert patience([], [1]) == []


def test_crossing_anchors_are_weighed_by_words(spark):
    rng = random.Random(2)
    for _ in range(100):
        common = list(enumerate(rng.sample(range(8), rng.randint(1, 8))))
        words = [rng.randint(0, 12) for _ in range(8)]
        rising = lambda c: all(x[1] < y[1] for x, y in zip(c, c[1:]))
        chain = _heaviest(common, words)
        best = max(
            sum(words[j] for _, j in c) for n in range(len(common) + 1) for c in combinations(common, n) if rising(c)
        )
        assert rising(chain) and set(chain) <= set(common) and sum(words[j] for _, j in chain) == best
    # A long line that crosses several shorter ones goes, whatever their number and that of the documents.
    short = ["one two three four", "five six", "seven eight"]
    rows = [(1, "\n".join([_line(0), *short])), (2, "\n".join([*short[:2], "own", short[2], _line(0)]))]
    assert _run(spark, rows)[2].text == "\n".join([*short[:2], "own", short[2]])
    assert _run(spark, rows + [(i, f"text {i}") for i in range(3, 600)])[2].text == _run(spark, rows)[2].text


def _line(k):
    return " ".join(f"w{k}_{j}" for j in range(9))


def _run(spark, rows, **rule):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r for r in line_dedup(df, LineDedup(**rule)).collect()}


def test_blocks_leave_the_later_document(spark):
    a = [_line(k) for k in range(6)]
    out = _run(
        spark,
        [(5, "\n".join(a)), (9, "\n".join(["own first", a[2], a[3], "own last"])), (2, "\n".join(["zzz", a[5]])), (7, "alone")],
    )
    assert out[2].text == "zzz\n" + a[5]
    assert out[5].text == "\n".join(a[:5]) and out[5].removed_lines == 1
    assert out[9].text == "own first\nown last" and out[9].removed_lines == 2
    assert out[7].text == "alone"


def test_short_blocks_and_order_stay(spark):
    a = [_line(k) for k in range(4)]
    out = _run(spark, [(1, "\n".join([*a, "so it is"])), (2, "new\nso it is"), (3, "\n".join([a[1], a[0], "x"]))])
    assert out[2].text == "new\nso it is"
    # Lines in another order: one of the two is aligned.
    assert out[3].removed_lines == 1


def test_a_third_of_the_corpus_shares_a_passage(spark):
    shared = [_line(k) for k in range(3)]
    rows = [(k, "\n".join([f"title {k}", *shared, f"end {k}"])) for k in range(100)]
    rows += [(1000 + k, "\n".join([_line(10_000 + k), _line(20_000 + k)])) for k in range(200)]
    rows += [(2000 + k, rows[5][1]) for k in range(30)]
    out = _run(spark, rows)
    assert out[0].removed_lines == 0
    assert all(out[k].text == f"title {k}\nend {k}" for k in range(1, 100))
    assert all(out[1000 + k].removed_lines == 0 for k in range(200))
    assert all(out[2000 + k].text == "" for k in range(30))


def test_a_hot_passage_in_long_documents(spark):
    shared = [_line(k) for k in range(3)]
    own = {k: [_line(1000 * k + 500 + j) for j in range(12)] for k in range(100)}
    rows = [(k, "\n".join([*own[k][:6], *shared, *own[k][6:]])) for k in range(100)]
    rows += [(1000 + k, _line(900_000 + k)) for k in range(700)]
    out = _run(spark, rows)
    assert out[0].removed_lines == 0
    assert all(out[k].text == "\n".join(own[k]) for k in range(1, 100))
    assert all(out[1000 + k].removed_lines == 0 for k in range(700))


def test_a_hot_passage_of_short_lines(spark):
    """Each line has an earlier owner of its own, and blank lines lie between them."""
    shared = ["one two three four five", "", "six seven", "eight nine ten"]
    rows = [(k, f"{line}\n{_line(k)}") for k, line in enumerate(shared)]
    rows += [(10 + k, "\n".join([_line(100 + 2 * k), *shared, _line(101 + 2 * k)])) for k in range(600)]
    out = _run(spark, rows)
    assert all(out[k].removed_lines == 0 for k in (0, 1, 2, 3, 10))
    assert all(out[10 + k].text == f"{_line(100 + 2 * k)}\n{_line(101 + 2 * k)}" for k in range(1, 600))


def test_a_passage_pasted_twice(spark):
    shared = [_line(k) for k in range(4)]
    short = ["one two three four five", "", "six seven", "eight nine ten"]
    rows = [
        (1, "\n".join([*shared, "end", *short])),
        (2, "\n".join(["a", *shared, "b", *shared, "c", *shared[1:3], "d", *short, "e", *short, "f", short[0]])),
        (3, "\n".join([_line(50), _line(51), "x", _line(50), _line(51)])),
        (4, "\n".join(["y", _line(50), _line(51), "z"])),
        (5, "\n".join(["u", _line(50), _line(51), "v", _line(50), _line(51), "w", _line(50), _line(51)])),
    ]
    out = _run(spark, rows)
    assert out[1].removed_lines == out[3].removed_lines == 0
    assert out[2].text == f"a\nb\nc\nd\ne\nf\n{short[0]}"
    assert out[4].text == "y\nz"
    assert out[5].text == "u\nv\nw"


def test_runs_are_those_of_each_start_and_end():
    rng = random.Random(3)
    for _ in range(50):
        rows = [[(rng.randint(0, 5), rng.choice([0, 1, 3, 5, 9])) for _ in range(rng.randint(0, 9))] for _ in range(4)]
        flat = [x for row in rows for x in row]
        edges = np.concatenate([[0], np.cumsum([len(row) for row in rows])])
        lines, words = (np.array([x[k] for x in flat], np.int64) for k in (0, 1))
        found, at = runs(lines.astype(np.uint64), words, edges, 8)
        expected = set()
        for r, row in enumerate(rows):
            for i in range(len(row)):
                for j in range(i + 2, len(row) + 1):
                    w = [x[1] for x in row[i:j]]
                    on = 0 < w[0] < 8 and sum(w) >= 8 > sum(w[:-1])
                    back = 0 < w[-1] < 8 and sum(w) >= 8 > sum(w[1:])
                    if on or back:
                        expected.add((r, tuple(x[0] for x in row[i:j])))
        assert len(set(zip(at.tolist(), found.tolist()))) == len(expected)
        assert len(set(found.tolist())) == len({x for _, x in expected})


def test_lines_of_the_table_survive_once(docs):
    rule = LineDedup()
    before = {r.doc_id: r.text.split("\n") for r in docs.collect()}
    first = {}
    for i in sorted(before):
        for line in before[i]:
            first.setdefault(line, i)
    out = line_dedup(docs, rule).collect()
    assert len(out) == len(before)
    for r in out:
        kept, gone = r.text.split("\n"), list(before[r.doc_id])
        if r.removed_lines == 0:
            assert kept == before[r.doc_id]
            continue
        if r.removed_lines == r.n_lines:
            kept = []
        for line in kept:
            gone.remove(line)
        assert len(gone) == r.removed_lines
        assert all(first[line] < r.doc_id for line in gone)


def test_odd_rows(odd_docs, no_docs):
    out = line_dedup(odd_docs)
    assert out.columns == [*odd_docs.columns, "n_lines", "removed_lines"]
    rows = {(r.doc_id, r.n): r for r in out.collect()}
    assert out.count() == odd_docs.count()
    texts = sorted((r.doc_id or -1, r.text or "") for r in out.collect())
    assert texts == sorted(
        (r.doc_id or -1, "" if r.doc_id == 7 else r.text or "") for r in odd_docs.collect()
    )
    assert rows[(1, 9)].text is None
    assert line_dedup(no_docs).count() == 0
