"""The training-data queries by name. SQL is given only where it can express a whole result."""

from tessera.llm.ann import op3_nearest
from tessera.llm.bpe import op11_bpe
from tessera.llm.collocations import op13_collocations
from tessera.llm.decontaminate import op10_decontaminate
from tessera.llm.language_id import op1_language_id
from tessera.llm.licenses import op7_licenses
from tessera.llm.merkle import op12_merkle
from tessera.llm.mixing import op4_mixing
from tessera.llm.pii import op9_pii
from tessera.llm.simhash import op8_simhash
from tessera.llm.token_binary import op5_token_binary
from tessera.llm.toxicity import op6_toxicity
from tessera.llm.warc_zip import op2_warc_zip

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_warc_zip": op2_warc_zip,
    "op3_nearest": op3_nearest,
    "op4_mixing": op4_mixing,
    "op5_token_binary": op5_token_binary,
    "op6_toxicity": op6_toxicity,
    "op7_licenses": op7_licenses,
    "op8_simhash": op8_simhash,
    "op9_pii": op9_pii,
    "op10_decontaminate": op10_decontaminate,
    "op11_bpe": op11_bpe,
    "op12_merkle": op12_merkle,
    "op13_collocations": op13_collocations,
}

# base32 of a SHA-1: eight groups of five hex digits give four letters each
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31) + 1, 1)"
_WARC = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first_id FROM q)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: {_LETTER}), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM r
"""

_CUT = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_LEAKS = f"""
WITH d AS (SELECT doc_id, {_CUT} AS w FROM documents), b AS (SELECT item_id, {_CUT} AS w FROM benchmark),
bn AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, l.n, unnest(range(1, len(w) - l.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bn) l WHERE len(w) >= l.n)),
f AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.k = dw.k),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM f GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

# crc32 bit by bit over the digits: a byte comes in by xor, each of its eight bits goes out by a shift (marked -1)
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: list_concat([ascii(x)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295::BIGINT)"
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_MERKLE = f"""
WITH RECURSIVE l AS (SELECT row_number() OVER () AS rid, doc_id, source, {_LEAF.format(text="text")} AS leaf,
  CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS forged FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
nodes AS (SELECT source AS tree, 0 AS lvl, pos, leaf AS d, n FROM a
  UNION ALL SELECT tree, lvl + 1, pos // 16, sha256(string_agg(d, '' ORDER BY pos)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 16, n),
s AS (SELECT tree, d, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, pos, d, n FROM s UNION ALL SELECT lvl + 1, pos // 16, sha256(string_agg(d, '' ORDER BY pos)), (n + 15) // 16 FROM tops WHERE n > 1 GROUP BY lvl, pos // 16, n),
r AS (SELECT tree, lvl, pos // 16 AS run, list(d ORDER BY pos) AS ds FROM nodes WHERE n > 1 GROUP BY ALL), t AS (SELECT lvl, pos // 16 AS run, list(d ORDER BY pos) AS ds FROM tops WHERE n > 1 GROUP BY ALL),
q AS (SELECT rid, lvl, ds, (pos // (16 ** lvl)::BIGINT) % 16 AS k FROM a JOIN r ON r.tree IS NOT DISTINCT FROM a.source AND r.run = pos // (16 ** (lvl + 1))::BIGINT
  UNION ALL SELECT rid, 1000 + lvl, ds, (s.pos // (16 ** lvl)::BIGINT) % 16 FROM a JOIN s ON s.tree IS NOT DISTINCT FROM a.source JOIN t ON t.run = s.pos // (16 ** (lvl + 1))::BIGINT),
p AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY lvl) AS i, array_to_string(ds[1 : k], '') AS lo, array_to_string(ds[k + 2 :], '') AS hi FROM q),
f AS (SELECT rid, 0 AS i, coalesce(forged, leaf) AS h FROM l UNION ALL SELECT f.rid, p.i, sha256(lo || h || hi) FROM f JOIN p ON p.rid = f.rid AND p.i = f.i + 1),
e AS (SELECT rid, arg_max(h, i) AS folded_root FROM f GROUP BY rid), g AS (SELECT rid, sha256(string_agg(lo || hi, '' ORDER BY i)) AS proof FROM p GROUP BY rid)
SELECT a.doc_id, a.leaf, s.d AS subroot, top.d AS root, coalesce(g.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = top.d AS verified
FROM a JOIN s ON s.tree IS NOT DISTINCT FROM a.source JOIN e ON e.rid = a.rid LEFT JOIN g ON g.rid = a.rid CROSS JOIN (SELECT d FROM tops WHERE n = 1) top
"""

_PHRASES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(unnest(ps), '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, w[i : i + m - 1] AS ws FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) s(m) WHERE len(w) >= m)),
f AS (SELECT lang, ws, len(ws) AS m, count(*) AS a FROM g GROUP BY lang, ws HAVING count(*) >= 30),
k AS (SELECT f.lang, f.ws, f.a, x.a AS l, y.a AS r, (2000000::HUGEINT * f.a) // (x.a::HUGEINT + y.a) AS score, c
  FROM (SELECT *, unnest(range(1, m)) AS c FROM f WHERE m > 1) f JOIN f x ON x.lang = f.lang AND x.ws = f.ws[1 : c] JOIN f y ON y.lang = f.lang AND y.ws = f.ws[c + 1 :]),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, c) = 1),
e AS (SELECT DISTINCT lang, ws[i : i + s.m - 1] AS ws, s.m, a FROM (SELECT lang, ws, f.m, a, s.m AS sm, unnest(range(1, f.m - s.m + 2)) AS i FROM f, (VALUES (2), (3)) s(m) WHERE f.m > s.m) z JOIN (VALUES (2), (3)) s(m) ON s.m = z.sm),
h AS (SELECT lang, ws, max(a) AS a FROM e GROUP BY lang, ws),
o AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, b.a, l, r, score FROM b LEFT JOIN h ON h.lang = b.lang AND h.ws = b.ws WHERE h.a IS NULL OR 100::HUGEINT * h.a < 80::HUGEINT * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n USING (lang) QUALIFY rank <= 2000
"""

# The others hash, learn, tokenize or draw in ways that SQL can't; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op2_warc_zip": _WARC, "op10_decontaminate": _LEAKS, "op12_merkle": _MERKLE, "op13_collocations": _PHRASES}
