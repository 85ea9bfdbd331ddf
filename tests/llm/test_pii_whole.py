"""The whole replacement against a plain version without Spark, automaton and shortcuts."""

import random
import time
import unicodedata

import pytest

from verdict_lake.llm import pii

DOCS = "doc_id long, text string"


def plain_entities(text):
    found = []

    def add(start, end, kind, canon):
        if not any(start < b and a < end for a, b, _, _ in found):
            found.append((start, end, kind, canon))

    for kind, pattern in pii.PATTERNS:
        for m in pattern.finditer(text):
            digits = "".join(c for c in m.group(1) if c.isdigit())
            canon = {"email": m.group(1).lower(), "secret": m.group(1), "ip": m.group(1)}.get(kind, digits)
            if kind == "card" and pii.luhn(digits) or kind == "ip" and max(map(int, canon.split("."))) > 255:
                continue
            add(m.start(1), m.end(1), kind, canon)
    for m in pii.TITLED.finditer(text):
        gender = [g for g, ts in pii.TITLES.items() if m.group(1) in ts][0]
        at, names = m.start(2), m.group(2).split(" ")
        for name in names[:-1]:
            own = pii.GENDER_OF.get(name, ("", gender))[1]
            add(at, at + len(name), f"given:{own}:{pii.script_of(name)}", unicodedata.normalize("NFC", name).casefold())
            at += len(name) + 1
        add(at, at + len(names[-1]), f"family:{pii.script_of(names[-1])}", unicodedata.normalize("NFC", names[-1]).casefold())
    for m in pii.KNOWN.finditer(text):
        add(m.start(1), m.end(1), f"given:{pii.GENDER_OF[m.group(1)][1]}:{pii.script_of(m.group(1))}", m.group(1).casefold())
        add(m.start(2), m.end(2), f"family:{pii.script_of(m.group(2))}", unicodedata.normalize("NFC", m.group(2)).casefold())
    return sorted(found)


def plain_replaced(texts):
    """Texts with surrogates: all entities move on together until none of a family meets another or a real one."""
    mentions = [plain_entities(t or "") for t in texts]
    genders = {}
    for _, _, kind, canon in (e for es in mentions for e in es):
        if kind.startswith("given"):
            genders.setdefault(canon, set()).update(kind.split(":")[1].replace("n", ""))

    def use(kind, canon):
        if not kind.startswith("given"):
            return kind
        return f"given:{next(iter(genders[canon])) if len(genders[canon]) == 1 else 'n'}:{kind.split(':')[2]}"

    attempt = {(use(k, c), c): 0 for es in mentions for _, _, k, c in es}
    family = lambda kind: kind.split(":")[0]
    real = {(family(k), c) for k, c in attempt}
    while True:
        to = {e: (family(e[0]), pii.surrogate(*e, n)) for e, n in attempt.items()}
        owner = {}
        for e in sorted(attempt, key=lambda e: (attempt[e], e[1], e[0]), reverse=True):
            owner[to[e]] = e
        moving = [e for e in attempt if owner[to[e]] != e or to[e] in real]
        if not moving:
            break
        for e in moving:
            attempt[e] += 1
    out = []
    for text, found in zip(texts, mentions):
        new, at = [], 0
        for start, end, kind, canon in found:
            e = use(kind, canon), canon
            new += [text[at:start], pii.in_format(e[0], text[start:end], pii.surrogate(*e, attempt[e]))]
            at = end
        out.append((None if text is None else "".join([*new, text[at:]]), len(found)))
    return out


def sample():
    draw = random.Random(8)
    people = [f"{draw.choice(['Mr', 'Mrs.', 'Dr.', 'Prof', 'Mx', 'M.', 'Frau', 'Señor', 'г-н'])} {draw.choice(['Xavi', 'Anna', 'Иван', 'John', 'Quim'])} {draw.choice(['Smith', 'O’Neil', 'Петров', 'Vega'])}" for _ in range(60)]
    others = ["JOHN SMITH, John Smith-Vega; Anna Vega.Mr. Vega", "Mr. Mr. John", "mail a.b@c.de, A.B@C.DE x@y", "10.0.0.1 999.1.1.1 1.2.3.4.5", "4785380592391139 4785 3805 9239 1139 4111111111111112", "+49 30 1234567, (030) 123-4567 +1-017-555-7713", "123-45-6789 x123-45-6789", "PASSWORD = ******** paſſword: hunter22 api-key='abcdef123456' token:short secret=------", None, "", "nothing", "M. Night", "Dr. Who Is Here Now", "٣٤٥-12-3456"]
    texts = others + [" and ".join(draw.sample(people, 3)) for _ in range(60)]
    draw.shuffle(texts)
    return texts + texts[:10]


@pytest.mark.parametrize("sent", [100_000, -1])
def test_whole_replacement_equals_the_plain_one(frame, monkeypatch, sent):
    monkeypatch.setattr(pii, "SENT_ROWS", sent)
    texts = sample()
    df = frame(DOCS, *enumerate(texts)).repartition(3)
    got = {r.doc_id: (r.text, r.n_entities) for r in pii.pii_report(df).collect()}
    assert [got[k] for k in range(len(texts))] == plain_replaced(texts)


def test_a_given_name_is_one_entity_under_all_titles(frame):
    df = frame(DOCS, (1, "Dr. Xavi Vega"), (2, "Mr. Xavi Vega"), (3, "Mrs. Quim Vega"), (4, "Mr. Quim Vega"))
    out = {r.doc_id: r.text.split(" ")[1:] for r in pii.pii_report(df).collect()}
    assert out[1] == out[2] and out[3] == out[4] and out[1][0] != out[3][0]
    assert out[1][0] in pii.GIVEN[("latin", "m")]


def test_columns_of_any_name_stay(frame):
    df = frame("doc_id long, text string, _r long, _d long, _m long, new long, rest long, body long, `a.b` long", (1, "Mr. John Smith", *range(7)))
    out = pii.with_surrogates(df)
    assert out.columns == [*df.columns, "n_entities"]
    assert tuple(out.first())[2:] == (*range(7), 2)


def test_very_many_entities_in_one_text_take_linear_time():
    text = " ".join(f"a{k}@b.de" for k in range(100_000))
    began = time.perf_counter()
    assert len(pii.entities(text)) == 100_000
    assert time.perf_counter() - began < 20


def test_masked_secrets_end(frame):
    df = frame(DOCS, (1, "password=******"), (2, "secret=------"), (3, "token: ......"))
    out = {r.doc_id: r.text for r in pii.pii_report(df).collect()}
    assert all(mask not in out[k] for k, mask in ((1, "*"), (2, "-"), (3, ".")))
