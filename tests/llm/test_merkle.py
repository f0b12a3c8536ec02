"""Merkle trees against a plain recursive version."""

import hashlib
import zlib

from tessera.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, at long, `a.b` int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def path(tree, k):
    out = []
    for nodes in tree[:-1]:
        run = k // 16 * 16
        out.append((nodes[run:k], nodes[k + 1 : run + 16]))
        k //= 16
    return out


def brute(rows):
    """rows(doc_id, text, lang, source, n_chars): every row's result, as a sorted list."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sources = {}
    for doc_id, text, lang, source, n in rows:
        forged = text.translate(low) if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else text
        sources.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n, text), doc_id, leaf(doc_id, source, lang, n, forged)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([r[2] for r in sorted(sources[s])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for k, (_, _, own, doc_id, forged) in enumerate(sorted(sources[s])):
            steps = path(trees[s], k) + path(top, at)
            folded = forged
            for left, right in steps:
                folded = h(*left, folded, *right)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], h(*(x for left, right in steps for x in left + right)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def result(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op12_merkle(spark, str(tmp_path)).collect()), key=repr)


def test_postorder_places():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 300, 4095, 4096):
        tree = levels([f"{k:064d}" for k in range(n)])
        top = merkle.height(n)
        log = merkle.build([x.encode() for x in tree[0]], top)
        assert len(tree) == top + 1 and len(log) == 64 * sum(map(len, tree))
        for level, nodes in enumerate(tree):
            for k, node in enumerate(nodes):
                p = merkle.postorder(level, k, n, top)
                assert log[64 * p : 64 * p + 64].decode() == node


def test_several_rounds_of_builders(spark, tmp_path):
    rows = [(k, f"Text {k % 700}", "en", "hot" if k < 4200 else f"s{k % 40}", k) for k in range(4600)]
    assert result(spark, tmp_path, rows) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(k, f"A{k}", None, None, None) for k in range(20)] + [(None, "x", "en", "a", 1), (None, None, None, "a", 1), (5, None, "en", "é", 0), (10, "", "en", "", 0)]
    rows += [(7, "Same", "de", "b", 4)] * 3 + [(7, "Other", "de", "b", 5), (0, "Q" * 50_000, "en", "long", 50_000)]
    got = result(spark, tmp_path, rows)
    assert got == brute(rows) and not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_one_row_and_none(spark, tmp_path):
    assert result(spark, tmp_path / "one", [(3, "Alone", "en", "a", 5)]) == brute([(3, "Alone", "en", "a", 5)])
    assert result(spark, tmp_path / "none", []) == []
