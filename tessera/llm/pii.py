"""Personal data by weak supervision.

Candidates come in four kinds: email, ip, card, phone. Base patterns (exact, leftmost, not
overlapping) give base spans, which always stay. Looser patterns give further candidates, many of them wrong: spelled-out
e-mail addresses, national phone numbers and bare runs of 7 to 11 digits, numbers of card length whatever their check digit,
four numbers with dots, and a fifth kind, ``secret``: values assigned to names of credentials, keys that show themselves by
their form, and any long word of letters and digits. It has no base pattern and comes after the four among equal starts. Three
labelers vote on every candidate (1 personal, 0 not, - abstains): a strict pattern (with check digits and ranges), a gazetteer
(mail domains, address ranges, issuer digits, dialling forms; for secrets the spread of letters) and the words before it. Expectation-maximisation over the votes
of all documents estimates each labeler's reliability per kind, with base spans as certain; the posterior trains a logistic span classifier on
the votes and on what no labeler looks at (length, kinds of characters, entropy, what stands before, place in
the line), which decides about the candidates that are not base spans.

Texts are scanned once in linear time: every search is anchored so that a long run of letters or digits
is not tried again from each of its places. EM and classifier see counts of vote and feature patterns (a bounded
table), never rows.

Defined results: NULL and empty texts have no spans; equal rows all stay; base spans of two kinds may
overlap each other; other spans never overlap a base span, nor one of their kind; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NATIONAL = re.compile(r"(?<![0-9+.(-])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_ABROAD = r"(?<![0-9+.(-])0[0-9]{2,4}[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9])"
_NATIONAL = re.compile(f"{_NATIONAL.pattern}|{_ABROAD}")
# a value that is assigned to a name of credentials, and keys that show themselves by their form
_NAME = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credentials?)[\x20]?\Z")
_VALUE = re.compile(r"[:=][\x20]?[\"']?([A-Za-z0-9+/_.=-]{8,}+)")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})(?![A-Za-z0-9])")
_BARE = re.compile(r"(?<![0-9A-Za-z.,+(/_-])[0-9]{7,11}(?![0-9A-Za-z_-]|[.,/][0-9])")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
_SPELLED = re.compile(r"[\x20]?[\[({][\x20]?at[\x20]?[\])}][\x20]?([A-Za-z0-9-]+(?:[\x20]?(?:\.|[\[({][\x20]?dot[\x20]?[\])}])[\x20]?[A-Za-z0-9-]+)+)", re.IGNORECASE)
# Words that announce a kind, and common ends of mail domains.
CONTEXT = {"email": ("mail", "contact", "write", "correo", "courriel", "address"), "ip": ("ip", "host", "server", "address", "from"), "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"), "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp"), "secret": ("token", "secret", "passw", "key", "credential", "auth", "bearer")}
NUMERIC_CONTEXT = ("version", "release", "isbn", "order", "invoice", "serial", "build", "sku", "section")
ENDS = ("com", "org", "net", "edu", "gov", "io", "co", "info", "es", "fr", "de", "uk", "us", "eu")
NEAR = 32


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind as listed."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    out, done = [], 0
    if "[" in text or "(" in text or "{" in text:
        for m in _SPELLED.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
            done = m.end()
    for pattern in (_NATIONAL, _BARE):
        out += [("phone", m.start(), m.end()) for m in pattern.finditer(text)]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 12 <= m.end() - m.start() <= 37 and 12 <= sum(map(str.isdigit, m.group())) <= 19]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text)]
    m = _VALUE.search(text)
    while m:  # signs of assignment are rare, so the names before them are looked at, not searched for
        named = _NAME.search(text, max(0, m.start() - 16), m.start())
        if named:
            out.append(("secret", *m.span(1)))
        m = _VALUE.search(text, m.end() if named else m.start() + 1)
    out += [("secret", m.start(), m.end()) for m in _KEY.finditer(text)]
    out += [("secret", m.start(), m.end()) for m in _LONG.finditer(text) if any(map(str.isdigit, m.group())) and any(map(str.isalpha, m.group()))]
    out.sort(key=lambda s: (s[1], ALL_KINDS.index(s[0]), -s[2]))
    # one sweep: a loose span goes where a base span, or a loose one of its kind, covers part of it
    busy = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in busy], list(itertools.accumulate((b for _, b in busy), max))
    kept, last = [], dict.fromkeys(ALL_KINDS, -1)
    for kind, a, b in out:
        k = bisect.bisect_left(starts, b)
        if not (k and reach[k - 1] > a) and last[kind] <= a:
            kept.append((kind, a, b))
            last[kind] = b
    return kept


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def votes(text: str, span: tuple[str, int, int]) -> str:
    """The three votes on a candidate, as one string."""
    kind, start, end = span
    value = text[start:end]
    before = text[max(0, start - NEAR) : start].lower()
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "email":
        strict = "0" if value.startswith(".") or ".." in value else "1"
        end_name = re.split(r"[^A-Za-z]+", value.lower())[-1]
        gazetteer = "1" if end_name in ENDS else "-"
    elif kind == "ip":
        parts = [p.lstrip("0") or "0" for p in value.split(".")]
        strict = "1" if all(len(p) <= 3 and int(p) <= 255 for p in parts) else "0"
        gazetteer = "0" if parts[0] in ("0", "127", "255") or len(parts[0]) > 3 else "1"
    elif kind == "card":
        strict = "1" if luhn(digits) and len(digits) in (13, 14, 15, 16, 19) else "0"
        gazetteer = "1" if digits[0] in "3456" else "-"
    elif kind == "secret":
        classes = sum(any(map(f, value)) for f in (str.isdigit, str.isupper, str.islower))
        strict = "1" if len(value) >= 16 and classes >= 2 else "0"
        spread = entropy(value)
        gazetteer = "1" if spread >= 3 else "0" if spread < 2.5 else "-"
    else:
        marks = {c for c in value if not c.isdigit() and c not in "+()"}
        strict = "1" if value[0] in "+(" or marks and len(marks) <= 2 else "0"
        gazetteer = "0" if len(set(digits)) <= 2 or digits.startswith("000") else "1" if value[0] in "+(" else "-"
    near = "1" if any(w in before for w in CONTEXT[kind]) else "0" if any(w in before for w in NUMERIC_CONTEXT) else "-"
    return strict + gazetteer + near


def features(text: str, span: tuple[str, int, int]) -> str:
    """What the classifier sees beside the votes: length, kinds of characters, entropy, the character before, place in the line."""
    _, start, end = span
    value = text[start:end]
    plain = re.sub(r"[^0-9A-Za-z]", "", value)
    length = "s" if len(value) <= 8 else "m" if len(value) <= 14 else "l" if len(value) <= 22 else "x"
    made = "d" if plain.isdigit() else "h" if re.fullmatch(r"[0-9a-f]*|[0-9A-F]*", plain) else "a" if any(map(str.isdigit, plain)) else "w"
    left = text[start - 1] if start else "\n"
    before = "q" if left in "\"'=:" else "s" if left.isspace() else "o"
    line = "b" if not text[text.rfind("\n", 0, start) + 1 : start].strip() else "i" if start - text.rfind("\n", max(0, start - 80), start) < 80 else "f"
    bits = entropy(value)
    return length + made + before + line + ("l" if bits < 2.5 else "m" if bits < 3.3 else "h")


_SPAN = pa.struct([("start", pa.int64()), ("order", pa.int32()), ("kind", pa.string()), ("end", pa.int64()), ("votes", pa.string()), ("base", pa.bool_())])
_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found array<struct<start:long,order:int,kind:string,end:long,votes:string,base:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, shas, found = [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            kinds = [s[0] for s in base]
            counts.append([kinds.count(k) for k in KINDS])
            shas.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())
            found.append([{"start": s[1], "order": ALL_KINDS.index(s[0]), "kind": s[0], "end": s[2], "votes": votes(text, s) + features(text, s), "base": flag} for flag, spans in ((True, base), (False, loose_spans(text, base))) for s in spans])
        columns = list(zip(*counts, strict=True)) if counts else [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(shas, pa.string()), pa.array(found, pa.list_(_SPAN))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "found"])


def reliabilities(patterns: list[tuple[str, float]], rounds: int = 50, sure: list[float] | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over (three votes, count): prior, P(vote 1 | personal) and P(vote 1 | not) per labeler, and the posterior per pattern.

    sure: how many more candidates of each pattern are personal for certain (base spans). They tell how labelers vote on those; the prior is of the others.
    """
    seen = np.array([[{"1": 1, "0": 0, "-": -1}[c] for c in v[:3]] for v, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    certain = np.zeros(len(n)) if sure is None else np.array(sure, float)
    prior, hit, miss = 0.7 if sure is None else 0.5, np.full(3, 0.8), np.full(3, 0.3)
    post = np.full(len(n), prior)
    for _ in range(rounds):
        like = [np.full(len(n), p) for p in (prior, 1 - prior)]
        for which, rate in enumerate((hit, miss)):
            like[which] = like[which] * np.prod(np.where(seen < 0, 1.0, np.where(seen == 1, rate, 1 - rate)), axis=1)
        post = like[0] / (like[0] + like[1])
        prior = float(np.clip((n @ post + 1) / (n.sum() + 2), 0.05, 0.95))
        for rate, weight, start in ((hit, n * post + certain, 4.0), (miss, n * (1 - post), 1.0)):
            for j in range(3):
                used = seen[:, j] >= 0
                rate[j] = (weight[used] @ seen[used, j] + start) / (weight[used].sum() + 5.0)
    return prior, np.stack([hit, miss]), post


def classifier(counted: list[tuple[str, str, float, bool]], rounds: int = 25) -> dict[str, float]:
    """(kind, votes and features, count, of base spans?) -> 'kind:votes' -> probability, by a logistic model of the EM posteriors."""
    n: dict[tuple[str, str], list[float]] = {}
    for kind, v, c, base in counted:
        n.setdefault((kind, v), [0.0, 0.0])[base] += c
    target: dict[tuple[str, str], float] = {}
    for kind in ALL_KINDS:
        own = {v: c for (k, v), c in n.items() if k == kind}
        if own:
            _, _, post = reliabilities([(v, c[0]) for v, c in own.items()], sure=[c[1] for c in own.values()])
            target |= {(kind, v): float((c[0] * p + c[1]) / sum(c)) for (v, c), p in zip(own.items(), post, strict=True)}
    if not target:
        return {}
    names = sorted({k for k, _ in target} | {f"{k}{j}{c}" for k, v in target for j, c in enumerate(v)})
    place = {n: j for j, n in enumerate(names)}
    x = np.zeros((len(target), len(names)))
    for row, (k, v) in enumerate(target):
        x[row, [place[k], *(place[f"{k}{j}{c}"] for j, c in enumerate(v))]] = 1
    y = np.array([*target.values()])
    w = np.array([sum(n[key]) for key in target], float)
    w, c = w / w.sum() * 100, np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        c = c + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(c)), x.T @ (w * (y - p)) - 0.1 * c)
    p = 1 / (1 + np.exp(-(x @ c)))
    return {f"{k}:{v}": float(q) for (k, v), q in zip(target, p, strict=True)}


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts and digest of the base spans, and all spans as an array and as text."""
    scanned = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, _SCHEMA), "pii-found")
    each = scanned.select(F.explode("found").alias("f")).groupBy("f.kind", "f.votes", "f.base").agg(F.count("*").alias("n"))
    counted = sorted((r["kind"], r["votes"], float(r["n"]), r["base"]) for r in each.collect())  # at most 5 kinds x 27 votes x 432 shapes
    good = [k for k, p in classifier(counted).items() if p >= 0.5]
    keep = F.filter("found", lambda s: s["base"] | F.concat_ws(":", s["kind"], s["votes"]).isin(*good)) if good else F.filter("found", lambda s: s["base"])
    spans = F.array_sort(F.transform(keep, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["kind"].alias("kind"), s["end"].alias("end"))))
    out = scanned.withColumn("all_spans", spans).drop("found")
    return out.withColumn("spans", F.array_join(F.transform("all_spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents")).drop("all_spans")
