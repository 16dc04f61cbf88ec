"""Filtering Lloyd against a plain one."""

import numpy as np
import pytest

from tidemark.llm import codebooks


def plain(x, ids, parts, entries, rounds):
    order = np.lexsort((*x.T[::-1], ids))
    n, width = len(x), x.shape[1] // parts
    points = x.reshape(n, parts, width).transpose(1, 0, 2)
    books = points[:, order[:entries]].copy()

    def nearest(p):
        return np.array([min(range(len(books[p])), key=lambda e: (int(((v - books[p][e]) ** 2).sum()), e)) for v in points[p]])

    for _ in range(rounds):
        for p in range(parts):
            code = nearest(p)
            for e in range(len(books[p])):
                if (code == e).any():
                    books[p][e] = points[p][code == e].sum(axis=0) // (code == e).sum()
    codes = np.stack([nearest(p) for p in range(parts)], axis=1)
    error = sum(((points[p] - books[p][codes[:, p]]) ** 2).sum(axis=1) for p in range(parts))
    return books, codes, error


@pytest.mark.parametrize("n", [1, 5, 15, 400])
def test_same_as_plain_lloyd(spark, n, monkeypatch):
    monkeypatch.setattr(codebooks, "BLOCK", 64)
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 8)).round(1 if n > 15 else 3).astype(np.float32)  # round values: ties and repeated rows
    labels = [None if i % 5 == 0 else i % 3 for i in range(n)]
    rows = [(i, x.tolist(), labels[i]) for i, x in enumerate(v)]
    odd = [(1000, None, 1), (1001, [1.0, None] * 4, 1), (1002, [float("nan")] * 8, 1), (1003, [float("inf")] * 8, 0), (1004, [], 0), (1005, [1.0] * 4, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(3)
    books, out = codebooks.compress(df, parts=4, entries=6, rounds=6, scale=10)
    x = np.floor(v.astype(float) * 10).astype(np.int64)
    want, codes, error = plain(x, np.arange(n), 4, 6, 6)
    assert (books == want).all()
    got = {r.vec_id: r for r in out.collect()}
    assert sorted(got) == list(range(n))
    by = {}
    for i in range(n):
        by[labels[i]] = by.get(labels[i], 0) + int(error[i])
    for i in range(n):
        assert (got[i].code, got[i].error, got[i].label_error) == (bytes(codes[i].astype(np.uint8)).hex(), error[i], by[labels[i]])


def test_filtering_settles_subtrees_whole(monkeypatch):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(0, 50, (2000, 3)), rng.integers(1000, 1050, (2000, 3))])
    book = np.array([[25, 25, 25], [1025, 1025, 1025]])
    looked = []
    real = codebooks._squares
    monkeypatch.setattr(codebooks, "_squares", lambda a, b: looked.append(a.size) or real(a, b))
    sums, counts, code = codebooks.filter_tree(points, codebooks.build_tree(points), book)
    assert counts.tolist() == [2000, 2000] and (sums[0] == points[:2000].sum(axis=0)).all() and (code == np.repeat([0, 1], 2000)).all()
    assert sum(looked) < points.size / 10


def test_repeated_null_and_clashing_rows(spark):
    rows = [(1, [0.5, 1.0], 3, 9), (1, [0.5, 1.0], 3, 9), (None, [7.0, 8.0], None, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code int")
    books, out = codebooks.compress(df, parts=2, entries=2, rounds=1, scale=4)
    assert books.tolist() == [[[10], [2]], [[13], [4]]]  # both entries start alike: ties go to the first, the other stays
    got = [(r.vec_id, r.code, r.error, r.label_error) for r in out.orderBy("vec_id").collect()]
    assert got == [(None, "0000", 685, 685), (1, "0101", 0, 0), (1, "0101", 0, 0)]
    none, empty = codebooks.compress(df.limit(0), parts=2)
    assert none.size == 0 and empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error"]


def test_lengths_and_sizes_are_checked(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="equal parts"):
        codebooks.compress(df, parts=2)
    big = spark.createDataFrame([(1, [-1e30, 2.0], 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        codebooks.compress(big, parts=2)
