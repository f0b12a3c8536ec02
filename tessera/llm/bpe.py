"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

Byte-pair encoding has a property that makes it a left-to-right problem: every prefix of a piece has
one encoding, so it has one last token, and a token ``t`` is that one exactly if it ends the prefix and
stays apart from the last token of what is before it. For each prefix the candidates are the vocabulary's tokens that
end there, found by a generalised suffix automaton of all tokens, longest first; two tokens stay apart if
undoing their merges, latest first, never shows a pair across the border that would have merged
earlier. The first candidate that stays apart is stored; back-pointers from the end give the ids.

All new pieces of a group of texts advance together, one byte at a time, as numpy columns; where only few long ones are
left, each goes on alone. Pieces are what the byte-level pre-tokenizer cuts. Their ids are kept in a cache bounded in
bytes; a full one keeps what the last group of texts found there.

The tables (automaton, merges, token bytes) are made once from the tokenizer file and broadcast: their
size depends on that file alone, about 20 MB for 50,000 tokens.

Defined results: NULL and empty text have no ids and decode to the empty text; the string of an added token
is that token; equal rows all stay; NULL doc_ids stay; an empty table gives no rows; further columns pass through,
whatever their names. Texts are encoded whole in time linear in their length; one without any space is one long word.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Cache, map_rows, slices, table
from tessera.llm.token_binary import _byte_letters

GROUP_BYTES, CACHE_BYTES, PIECE_BYTES = 2_000_000, 40 << 20, 2 << 20
FEW, ASKED = 24, 19
_FAR = np.iinfo(np.int32).max
# the pre-tokenizer's pieces for texts up to U+024F, whose classes are the same in all versions of Unicode
_LATIN = re.compile(r"[\x00-\u024f]*")
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def suffix_automaton(strings: list[bytes]) -> tuple[list[dict[int, int]], list[int], list[int], list[int]]:
    """(transitions, suffix link, longest length, index of the string that is the state's longest or -1)."""
    steps: list[dict[int, int]] = [{}]
    link, size, whole = [-1], [0], [-1]

    def state(length: int, like: int | None = None) -> int:
        steps.append({} if like is None else steps[like].copy())
        link.append(-1 if like is None else link[like])
        size.append(length)
        whole.append(-1)
        return len(size) - 1

    def redirected(at: int, byte: int) -> int:
        """The state that ``byte`` leads to from ``at``, split off if it also holds longer runs."""
        old = steps[at][byte]
        if size[old] == size[at] + 1:
            return old
        copy = state(size[at] + 1, old)
        link[old] = copy
        while at >= 0 and steps[at].get(byte) == old:
            steps[at][byte] = copy
            at = link[at]
        return copy

    for k, string in enumerate(strings):
        last = 0
        for byte in string:
            if byte in steps[last]:
                last = redirected(last, byte)
                continue
            new, at = state(size[last] + 1), last
            while at >= 0 and byte not in steps[at]:
                steps[at][byte] = new
                at = link[at]
            link[new] = 0 if at < 0 else redirected(at, byte)
            last = new
        whole[last] = k
    return steps, link, size, whole


@dataclass
class Tables:
    """All that encoding and decoding need of a vocabulary, by token id."""

    spelled: list[bytes]  # bytes of a token
    added: dict[str, int]
    rank: np.ndarray  # place of the merge that makes a token; -1 for single bytes
    left: np.ndarray  # and its two parts
    right: np.ndarray
    pairs: np.ndarray  # sorted keys of mergeable pairs, and their ranks
    pair_rank: np.ndarray
    keys: np.ndarray  # sorted state * 256 + byte of the automaton, and where they lead
    to: np.ndarray
    link: np.ndarray
    size: np.ndarray
    near: np.ndarray  # the longest token among a state's longest run and its suffixes
    shorter: np.ndarray  # the next shorter token that ends a token

    @property
    def length(self) -> np.ndarray:
        return np.array([len(b) for b in self.spelled], np.int32)


def read_tables(path: str) -> Tables:
    """Tables of a byte-level BPE tokenizer file. Other kinds of files are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if model.get("type") != "BPE" or not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("not a plain byte-level BPE tokenizer")
    vocab, code = model["vocab"], {letter: byte for byte, letter in _byte_letters().items()}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    n = 1 + max([*vocab.values(), *added.values()])
    spelled = [b""] * n
    for content, k in added.items():
        spelled[k] = content.encode()
    for letters, k in vocab.items():
        if not all(x in code for x in letters):
            raise ValueError("a token is not spelled in byte letters")
        spelled[k] = bytes(code[x] for x in letters)
    rank, left, right = (np.full(n, -1, np.int32) for _ in range(3))
    pairs: dict[int, int] = {}
    for place, merge in enumerate(model["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        x, y, made = vocab[a], vocab[b], vocab[a + b]
        pairs.setdefault(x * n + y, place)
        if rank[made] < 0:
            rank[made], left[made], right[made] = place, x, y
    keys = np.array(sorted(pairs), np.int64)
    out = Tables(spelled, added, rank, left, right, keys, np.array([pairs[k] for k in keys.tolist()], np.int32), *(np.zeros(0, np.int64) for _ in range(6)))
    sound = [k for k in range(n) if len(spelled[k]) == 1 and k not in added.values()]
    if len({spelled[k] for k in sound}) != 256:
        raise ValueError("a byte has no token")
    made = np.flatnonzero(rank >= 0)
    made = made[np.argsort(rank[made])]
    apart = Encoder(out).apart(left[made].astype(np.int64), right[made].astype(np.int64), rank[made])
    good = set(sound)
    for k, ok in zip(made.tolist(), apart.tolist(), strict=True):  # tokens that their own bytes encode to; no others are ever chosen
        if ok and int(left[k]) in good and int(right[k]) in good:
            good.add(k)
    tokens = sorted(good)
    steps, link, size, whole = suffix_automaton([spelled[k] for k in tokens])
    order = np.argsort(np.array(size), kind="stable").tolist()
    near, shorter = np.full(len(size), -1, np.int32), np.full(n, -1, np.int32)
    for s in order:  # suffix links lead to shorter runs, which come first
        up = int(near[link[s]]) if link[s] >= 0 else -1
        near[s] = up
        if whole[s] >= 0:
            near[s], shorter[tokens[whole[s]]] = tokens[whole[s]], up
    flat = sorted((s << 8 | byte, to) for s, step in enumerate(steps) for byte, to in step.items())
    out.keys, out.to = np.array([k for k, _ in flat] + [np.iinfo(np.int64).max], np.int64), np.array([t for _, t in flat] + [0], np.int32)
    out.link, out.size, out.near, out.shorter = np.array(link, np.int32), np.array(size, np.int32), near, shorter
    return out


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, tables: Tables):
        self.t, self.length, self.n = tables, tables.length, len(tables.spelled)
        self.known = Cache(CACHE_BYTES)
        self.asked, self.told = np.full(1 << ASKED, -1, np.int64), np.zeros(1 << ASKED, bool)
        self.added = re.compile("|".join(map(re.escape, sorted(tables.added, key=len, reverse=True)))) if tables.added else None
        self._other = None

    def apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Do tokens a and b, side by side, stay two tokens? limit: only merges of a lower rank count."""
        t, ok, at = self.t, np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), _FAR, np.int32) if limit is None else limit
        while len(at):
            key = a.astype(np.int64) * self.n + b
            place = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
            merges = (t.pairs[place] == key) & (t.pair_rank[place] < limit)
            ok[at[merges]] = False
            ra, rb = t.rank[a], t.rank[b]
            go = ~merges & ((ra >= 0) | (rb >= 0))
            a, b, ra, rb, at = a[go], b[go], ra[go], rb[go], at[go]
            undo = ra > rb  # of equal ranks the left merged first, so the right is undone first
            limit = np.where(undo, ra, rb + 1)
            a, b = np.where(undo, t.right[a], a), np.where(undo, b, t.left[b])
        return ok

    def _remembered(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``apart`` with a table of answers; a later pair takes the place of an earlier one."""
        key = a.astype(np.int64) * self.n + b
        at = (key * 0x9E3779B1 >> 16) & (len(self.asked) - 1)
        ok = self.told[at]
        new = np.flatnonzero(self.asked[at] != key)
        if len(new):
            ok[new] = self.apart(a[new], b[new])
            # equal pairs have equal answers; of different pairs at a place the last one stays in both tables
            self.asked[at[new]] = key[new]
            self.told[at[new]] = ok[new]
        return ok

    def _step(self, state: np.ndarray, size: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The automaton after one more byte: state and length of the longest run that ends here and is in some token."""
        t, to, todo = self.t, np.zeros_like(state), np.arange(len(state))
        size = size.copy()
        while len(todo):
            key = state[todo].astype(np.int64) << 8 | byte[todo]
            place = np.searchsorted(t.keys, key)
            hit = t.keys[place] == key
            to[todo[hit]] = t.to[place[hit]]
            size[todo[hit]] += 1
            todo = todo[~hit]
            state = state.copy()
            state[todo] = t.link[state[todo]]
            size[todo] = t.size[state[todo]]
        return to, size

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of non-empty pieces, all of them at once."""
        t = self.t
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-lengths, kind="stable")
        lens = lengths[order]
        data = np.frombuffer(b"".join(pieces[k] for k in order.tolist()), np.uint8)
        start = np.cumsum(lens) - lens
        row = start + np.arange(len(lens))  # one place more a piece, for the empty prefix
        last = np.full(len(data) + len(lens), -1, np.int32)
        state, size = np.zeros(len(lens), np.int32), np.zeros(len(lens), np.int32)
        for j in range(int(lens[0]) if len(lens) else 0):
            live = int(np.searchsorted(-lens, -j, "left"))  # pieces longer than j
            if live <= FEW:
                for k in range(live):
                    self._finish(data[start[k] : start[k] + lens[k]].tobytes(), j, int(state[k]), int(size[k]), last[row[k] : row[k] + lens[k] + 1])
                break
            state, size = self._step(state[:live], size[:live], data[start[:live] + j])
            token = np.where(size == t.size[state], t.near[state], t.near[t.link[state]])
            todo = np.arange(live)
            while len(todo):
                before = j + 1 - self.length[token]
                ok = before == 0
                ask = np.flatnonzero(~ok)
                ok[ask] = self._remembered(last[row[todo[ask]] + before[ask]], token[ask])
                last[row[todo[ok]] + j + 1] = token[ok]
                todo, token = todo[~ok], t.shorter[token[~ok]]
        at, where, found, turn = lens.copy(), np.arange(len(lens)), [], 0
        count = np.zeros(len(lens), np.int64)
        while len(where):
            token = last[row[where] + at[where]]
            found.append((where, token))
            at[where] -= self.length[token]
            count[where] += 1
            where = where[at[where] > 0]
            turn += 1
        ends = np.cumsum(count)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, "<u4")
        for k, (where, token) in enumerate(found):
            ids[ends[where] - 1 - k] = token
        raw, out = ids.tobytes(), [b""] * len(pieces)
        for k, a, b in zip(order.tolist(), ((ends - count) * 4).tolist(), (ends * 4).tolist(), strict=True):
            out[k] = raw[a:b]
        return out

    def _finish(self, piece: bytes, done: int, state: int, size: int, last: np.ndarray) -> None:
        """The same for one piece whose first ``done`` bytes are known, with plain numbers and a store of asked pairs."""
        t, keys, ends, asked = self.t, self.t.keys, last.tolist(), {}
        steps: dict[int, int] = {}
        for j in range(done, len(piece)):
            while True:
                key = state << 8 | piece[j]
                to = steps.get(key)
                if to is None:
                    place = int(np.searchsorted(keys, key))
                    to = steps[key] = int(t.to[place]) if keys[place] == key else -1
                if to >= 0:
                    state, size = to, size + 1
                    break
                state = int(t.link[state])
                size = int(t.size[state])
            token = int(t.near[state] if size == t.size[state] else t.near[t.link[state]])
            while True:
                before = j + 1 - len(t.spelled[token])
                pair = (ends[before], token)
                if before and pair not in asked:
                    asked[pair] = bool(self.apart(np.array([pair[0]]), np.array([token]))[0])
                if not before or asked[pair]:
                    break
                token = int(t.shorter[token])
            ends[j + 1] = token
        last[:] = ends

    def cut(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces."""
        if _LATIN.fullmatch(text):
            return _PIECE.findall(text)
        if self._other is None:
            from tokenizers import pre_tokenizers

            self._other = pre_tokenizers.ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self._other.pre_tokenize_str(text)]

    def _learn(self, pieces: set[str]) -> None:
        """Ids of pieces that are not known yet, in groups of bounded size."""
        todo, size, some = self.known.missing(pieces), 0, []
        for k, piece in enumerate(todo, 1):
            some.append(piece.encode())
            size += len(some[-1])
            if size >= PIECE_BYTES or k == len(todo):
                self.known.add(todo[k - len(some) : k], self._pieces(some))
                some, size = [], 0

    def encode(self, texts: list[str]) -> list[bytes]:
        rows: list[list[list[str]]] = []  # of each text the pieces of what lies between added tokens
        marks: list[list[int]] = []
        for text in texts:
            cuts, ids, at = [], [], 0
            for m in self.added.finditer(text) if self.added else ():
                cuts.append(self.cut(text[at : m.start()]))
                ids.append(self.t.added[m.group()])
                at = m.end()
            rows.append([*cuts, self.cut(text[at:] if at else text)])
            marks.append(ids)
        self._learn(set().union(*(pieces for cuts in rows for pieces in cuts)))
        get, out = self.known.__getitem__, []
        for cuts, ids in zip(rows, marks, strict=True):
            done = [b"".join(map(get, cuts[0]))]
            for token, pieces in zip(ids, cuts[1:], strict=True):
                done += [token.to_bytes(4, "little"), *map(get, pieces)]
            out.append(b"".join(done))
        return out


def _broadcast(spark: SparkSession, tokenizer: str | None):
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return spark.sparkContext.broadcast(read_tables(tokenizer))


def _with(rows: DataFrame, name: str, kind: T.DataType, source: str, change) -> DataFrame:
    """rows with a further column (or another content of it): change(list of values) for slices of bounded size."""
    if name in rows.columns and name != source:
        raise ValueError(f"there is a column {name} already")
    at = rows.columns.index(source)
    fields = [f for f in rows.schema.fields if f.name != name]
    schema = T.StructType([*fields, T.StructField(name, kind)])
    keep = [k for k, f in enumerate(rows.schema.fields) if f.name != name]
    labels = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = change()
        for batch in batches:
            for some in slices(batch, at, GROUP_BYTES):
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in keep), work(some.column(at))], names=labels)

    return map_rows(rows, run, schema)


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text", ids: str = "ids", tables=None) -> DataFrame:
    """docs with ``ids``: the token ids of ``text`` as little-endian unsigned 32-bit integers."""
    shared = tables or _broadcast(docs.sparkSession, tokenizer)

    def change():
        encoder = Encoder(shared.value)
        return lambda part: pa.array(encoder.encode([t or "" for t in part.to_pylist()]), pa.binary())

    return _with(docs, ids, T.BinaryType(), text, change)


def decode(rows: DataFrame, tokenizer: str | None = None, ids: str = "ids", text: str = "text", tables=None) -> DataFrame:
    """rows with ``text``: what the ids spell, added tokens included; bytes that are no UTF-8 become U+FFFD."""
    shared = tables or _broadcast(rows.sparkSession, tokenizer)

    def change():
        spelled = shared.value.spelled.__getitem__
        return lambda part: pa.array([b"".join(map(spelled, np.frombuffer(x.as_buffer() or b"", "<u4").tolist())).decode("utf-8", "replace") for x in part.fill_null(b"")], pa.string())

    return _with(rows, text, T.StringType(), ids, change)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = table(spark, sf_dir, "documents").select("doc_id", "text"), _broadcast(spark, None)
    ids = encode(docs, tables=tables).select("doc_id", "ids")
    both = decode(ids, text="decoded", tables=tables)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
