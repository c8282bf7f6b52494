"""Values and texts of any length, and pseudonyms against a plain version of the permutation."""

import hashlib

import pytest

from reelspark.llm import pseudonyms
from test_texts import luhn

CARD = "4111 1111 1111 1111"
LONG = [
    "7 " * 200_000, "1234 " * 50_000, "x a@b" + ".c" * 100_000, "1" * 1_000_000, "7-" * 100_000 + CARD, "a.b" * 100_000 + "@c.de", "1.2.3.4." * 50_000,
    f"{CARD} " * 3_000, "2024-02-29-" * 2_000, "(" * 50_000 + "+1 " * 50_000,
]


@pytest.fixture(scope="module")
def changed(make):
    return {r.row.doc_id: r for r in pseudonyms.pseudonymise(make(LONG), "k").collect()}


def test_long_values_stay_or_change_as_short_ones(changed):
    for i in (0, 2, 3, 5):
        assert changed[i].text == LONG[i] and not changed[i].found, i
    # the leftmost run of groups that is a card takes some sevens along
    assert CARD not in changed[4].text and [f.kind for f in changed[4].found] == ["card"] and changed[4].text.startswith("7-" * 99_990)
    assert CARD not in changed[7].text and len(changed[7].found) == 3_000 and len({f.text for f in changed[7].found}) == 1
    assert all(len(changed[i].text) == len(t) for i, t in enumerate(LONG))


def plain(symbols, radices, key, tweak):
    """The Feistel network in plain Python."""
    half = len(symbols) // 2
    parts = [symbols[:half], symbols[half:]]
    for r in range(pseudonyms.ROUNDS):
        own, other = r % 2, 1 - r % 2
        seed = ",".join([key, tweak, str(r), ".".join(map(str, parts[other]))])
        shifts = [int(hashlib.sha256(f"{seed},{i}".encode()).hexdigest()[:12], 16) for i in range(len(parts[own]))]
        radix = radices[:half] if own == 0 else radices[half:]
        parts[own] = [(s + d) % m for s, d, m in zip(parts[own], shifts, radix)]
    return parts[0] + parts[1]


@pytest.mark.parametrize("card", ["4111111111111111", "378282246310005", "6011 0009 9013 9424"])
def test_cards_against_plain_permutation(spark, make, card):
    digits = [int(c) for c in card if c.isdigit()]
    middle = plain(digits[1:-1], [10] * (len(digits) - 2), "secret", f"card{digits[0]}")
    body = [digits[0], *middle]
    check = next(d for d in range(10) if luhn("".join(map(str, [*body, d]))))
    new = iter(map(str, [*body, check]))
    want = "".join(next(new) if c.isdigit() else c for c in card)
    row = pseudonyms.pseudonymise(make([f"pay {card} now"]), "secret").first()
    assert row.text == f"pay {want} now" and luhn(want.replace(" ", ""))


def test_addresses_and_mail_against_plain_permutation(spark, make):
    octets = [10, 200, 3, 77]
    new = plain(octets[1:], [256] * 3, "s", "address.10")
    signs = "joe9"
    code = [ord(c) - (48 if c.isdigit() else 97) for c in signs]
    moved = plain(code, [10 if c.isdigit() else 26 for c in signs], "s", "mail@x.org")
    mail = "".join(chr(m + (48 if c.isdigit() else 97)) for m, c in zip(moved, signs))
    row = pseudonyms.pseudonymise(make(["at 10.200.3.77 or joe9@X.org"]), "s").first()
    assert row.text == f"at 10.{new[0]}.{new[1]}.{new[2]} or {mail}@X.org"
