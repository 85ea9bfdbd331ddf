"""Numbers and addresses by patterns, checks and surrogates written anew."""

import ipaddress
import re

from verdict_lake.llm import pii

DOCS = "doc_id long, text string"


def valid_iban(text):
    moved = text.replace(" ", "")[4:] + text.replace(" ", "")[:4]
    rest = 0
    for c in moved:
        n = ord(c) - 48 if c.isdigit() else ord(c) - 55
        rest = (rest * (10 if n < 10 else 100) + n) % 97
    return rest == 1


def out_of(frame, *texts):
    return [(r.text, r.n_entities) for r in pii.pii_report(frame(DOCS, *enumerate(texts))).orderBy("doc_id").collect()]


def test_ibans_keep_country_layout_and_checksum(frame):
    first, spaced, wrong, again = out_of(frame, "to DE89370400440532013000.", "to DE89 3704 0044 0532 0130 00, GB82 WEST 1234 5698 7654 32", "DE88370400440532013000", "DE89370400440532013000 twice")
    a = re.search(r"DE\d{20}", first[0]).group()
    assert first[1] == 1 and a != "DE89370400440532013000" and valid_iban(a)
    b = re.search(r"DE\d\d(?: \d{4}){4} \d\d", spaced[0]).group()
    c = re.search(r"GB\d\d [A-Z]{4}(?: \d{4}){3} \d\d", spaced[0]).group()
    # one account, one replacement, however it is written
    assert spaced[1] == 2 and b.replace(" ", "") == a and a in again[0] and valid_iban(c) and "WEST" not in c
    assert wrong[0].endswith("DE88370400440532013000") or wrong[1] != 1


def test_ipv6_addresses_and_what_only_looks_like_them(frame):
    long, short, upper, time_, code, mac = out_of(frame, "at 2001:db8:0:0:8:800:200c:417a now", "at 2001:db8::8:800:200c:417a now", "2001:DB8::8:800:200C:417A", "12:30:45 and 1:2:3", "std::abs a::b", "00:1a:2b:3c:4d:5e")
    a = long[0].split(" ")[1]
    assert ipaddress.IPv6Address(a) and a != "2001:db8:0:0:8:800:200c:417a" and long[1] == short[1] == upper[1] == 1
    assert short[0].split(" ")[1] == a and upper[0] == a.upper()
    assert [x[1] for x in (time_, code, mac)] == [0, 0, 0]


def test_national_phone_numbers_keep_their_form(frame):
    dashes, dots, plus, others = out_of(frame, "call 555-123-4567 now", "call 555.123.4567!", "call (555) 123-4567", "1.555-123-4567 555-123.4567 x555-123-4567 555-123-45678 1234-555-123-4567 555.123.4567.8")
    assert re.fullmatch(r"call \d{3}-\d{3}-\d{4} now", dashes[0]) and "555-123-4567" not in dashes[0]
    assert re.fullmatch(r"call \d{3}\.\d{3}\.\d{4}!", dots[0])
    # the same number in each form
    assert re.sub(r"\D", "", dashes[0]) == re.sub(r"\D", "", dots[0]) == re.sub(r"\D", "", plus[0]) != "5551234567"
    assert others[1] == 0
