"""Entities whose first surrogates can't all be free."""

import pytest

from verdict_lake.llm import pii

MANY = [("given:m:cyrillic", f"имя{chr(1072 + k // 25)}{chr(1072 + k % 25)}") for k in range(700)]


@pytest.mark.parametrize("kind, canon", [("secret", "********"), ("secret", "*****a"), ("email", "a@b.co"), ("phone", "12345"), ("ssn", "123456789"), ("card", "4111111111111111"), MANY[0], ("family:latin", "x")])
def test_every_kind_has_more_replacements_with_the_attempt(kind, canon):
    first, late = (pii.surrogate(kind, canon, k) for k in (0, 40))
    assert canon not in (first, late) and len(late) > len(first)
    if kind == "card":
        assert pii.luhn(first) == pii.luhn(late) == 0


def test_more_names_than_three_of_the_pool_and_symbols_alone_come_to_an_end(frame):
    # 8 + 64 + 512 names of up to three parts are fewer than these
    found = frame("kind string, canon string", *MANY, ("secret", "********"), ("secret", "######"))
    new = [(r.kind.split(":")[0], pii.surrogate(r.kind, r.canon, r.attempt)) for r in pii.attempts_needed(found).collect()]
    assert len(set(new)) == len(new) == 702
    assert not {n for _, n in new} & {c for _, c in MANY}


def test_a_secret_of_symbols_is_replaced():
    text, n = pii.replaced("password: ********", {})
    assert n == 1 and "********" not in text


def test_listed_names_that_are_all_in_use_get_names_of_one_word(frame):
    found = [(f"given:{gender}:{script}", name.casefold()) for (script, gender), names in pii.GIVEN.items() for name in names]
    new = {(r.kind, r.canon): pii.surrogate(r.kind, r.canon, r.attempt) for r in pii.attempts_needed(frame("kind string, canon string", *found)).collect()}
    assert len(new) == len(found) == 56 and len(set(new.values())) == 56
    assert not set(new.values()) & {canon for _, canon in found}
    for (kind, _), name in new.items():
        _, gender, script = kind.split(":")
        assert name.isalpha() and len(name) <= 14 and pii.script_of(name) == script and name.endswith(pii.ENDINGS[script, gender])
