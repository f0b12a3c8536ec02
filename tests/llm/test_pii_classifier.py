"""The span classifier takes some candidates of a kind and refuses others."""

import random

from tessera.llm import pii


def test_candidates_of_one_kind_taken_and_refused(spark):
    draw = random.Random(7)

    def digits(n):
        return "".join(draw.choice("0123456789") for _ in range(n))

    def luhn_number(ok):
        while True:
            x = "4" + digits(15)
            if pii.luhn(x) == ok:
                return x

    texts, taken, refused = [], [], []
    for k in range(200):
        phone, order, token, plain = f"({200 + k}) 555-{1000 + k}", f"{draw.randint(1, 9)}{digits(8)}", "".join(draw.choice("0123456789" if j % 5 else "abcdef") for j in range(40)), "aaaaaaaabbbbbbbb11"
        wrong = luhn_number(False)
        t = f"call {phone} about it, mail a{k}@x.org\nsee order {order} and card {luhn_number(True)} or item {wrong}\nkey = {token} id/{plain} +49 170 {digits(7)}"
        texts.append(t)
        taken += [(k, "phone", t.index(phone)), (k, "secret", t.index(token))]
        refused += [(k, "phone", t.index(order)), (k, "card", t.index(wrong)), (k, "secret", t.index(plain))]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {(r.doc_id, s.kind, s.start) for r in rows for s in r.all_spans}
    assert set(taken) <= got and not set(refused) & got
    found = {(k, kind, a) for k, t in enumerate(texts) for kind, a, _ in pii.loose_spans(t, pii.base_spans(t))}
    assert {x for x in refused if x[1] != "secret"} <= found and set(taken) <= found


def test_features_see_what_votes_do_not():
    text = "x 4000 token=deadbeef00 and\n12345678"
    a, b = text.index("deadbeef00"), text.index("12345678")
    assert pii.features(text, ("secret", a, a + 10))[:4] == "mhqi" and pii.features(text, ("phone", b, b + 8))[:4] == "sdsb"
