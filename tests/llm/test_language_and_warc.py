"""Sparse contexts against full rows; one response a payload however rows repeat."""

import glob
import gzip
import io
import re
import zipfile

import numpy as np
import pyarrow as pa

from tessera.llm import language_id, warc_zip


def test_sparse_contexts_cost_what_full_rows_cost():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdeé nst")) for _ in range(2000)) for _ in range(6)]
    counts = next(language_id._count(iter([pa.RecordBatch.from_pydict({"lang": ["x"] * 6, "text": texts})])))
    grams, n = counts.column("gram").to_numpy(), counts.column("n").to_numpy().astype(float)
    raw = np.frombuffer(language_id.PAD + "".join(rng.choice(list("abcdeé nstxyzß")) for _ in range(4000)).encode(), np.uint8).astype(np.int32)
    a, b, c, s = raw[:-3], raw[1:-2], raw[2:-1], raw[3:]
    full, some, none = (language_id.Table(grams, n, k).position_bits(a << 8 | b, b << 8 | c, c, s) for k in (1 << 20, 40, 0))
    assert np.allclose(full, some, atol=1e-4) and np.allclose(full, none, atol=1e-4)


def test_one_response_a_payload(spark, tmp_path):
    rows = [(5, "http://a", "same"), (5, "http://a", "same"), (5, "http://a", "same"), (5, "http://b", "same"), (7, "http://a", "same"), (None, "u", "same"), (1, None, "own"), (1, None, "own"), (2, "x", None), (3, "x", ""), (3, "y", ""), (9, "z", "alone"), (None, None, "none"), (None, None, "none")]
    spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, `a.b` int").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in warc_zip.op2_warc_zip(spark, str(tmp_path)).collect()), key=repr)
    want, seen = [], set()
    for page, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        html = html or ""
        ids = [p for p, _, h in rows if (h or "") == html and p is not None]
        first = html not in seen
        seen.add(html)
        want.append((page, len(html), warc_zip.base32_sha1(html.encode()), "response" if first else "revisit", None if first else min(ids, default=None)))
    assert got == sorted(want, key=repr)

    out = str(tmp_path / "archives")
    warc_zip.write_archives(spark.read.parquet(f"{tmp_path}/pages.parquet"), out)
    names = []
    for path in glob.glob(f"{out}/*.zip"):
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None
            names += re.findall(rb"WARC-Record-ID: (\S+)", gzip.GzipFile(fileobj=io.BytesIO(z.read(warc_zip.WARC))).read())
    assert len(names) == len(set(names)) == len(rows) and not glob.glob(f"{out}/*.cdx*")
