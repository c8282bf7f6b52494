"""Cards beside other numbers."""

import pytest

from reelspark.llm import pseudonyms
from test_texts import luhn

CARD = "4111 1111 1111 1111"
CASES = [
    ("{} 123", CARD), ("{} 737", CARD.replace(" ", "")), ("room 12 {}", CARD), ("2024 {}", CARD), ("12-{}-99 x", CARD.replace(" ", "-")),
    ("7 {} 12 34", CARD), ("{} 2024-02-29", CARD), ("{} 4539148803436467", CARD), ("{}", CARD), ("no. 1 {} 2024-02-29-", CARD),
]


@pytest.fixture(scope="module")
def changed(make):
    return {r.row.doc_id: r for r in pseudonyms.pseudonymise(make([c.format(v) for c, v in CASES] + ["1234 5678 9012 3456 12"]), "k").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cards_beside_numbers(changed, i):
    form, card = CASES[i]
    row = changed[i]
    new = next(f.text for f in row.found if f.kind == "card")
    assert card not in row.text and row.text.startswith(form.format(new).split("2024-")[0].split("4539")[0])
    assert luhn("".join(c for c in new if c.isdigit())) and len(new) == len(card) and new[0] == "4"
    assert "4539148803436467" not in row.text and len(row.text) == len(form.format(card))
    if i == 6:
        assert "2024-02-29" not in row.text and [f.kind for f in row.found] == ["card", "date"]
    if i == 7:
        assert [f.kind for f in row.found] == ["card", "card"]


def test_chains_without_card_stay(changed):
    assert changed[len(CASES)].text == "1234 5678 9012 3456 12" and not changed[len(CASES)].found
