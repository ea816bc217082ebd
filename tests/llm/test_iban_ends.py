"""IBANs before words in capitals or digits."""

import pytest

from ledgerloom.llm import pii

DE, NO, BE, FR = "DE89370400440532013000", "NO9386011117947", "BE68539007547034", "FR1420041010050500013M02606"


def found(text):
    return [text[s.start : s.end] for s in pii.find(text) if s.kind == "iban"]


@pytest.mark.parametrize("tail", [" BIC COBADEFFXXX", " 12 items", " EUR", " A B C", " 2", ".", " BIC COBADEFFXXX EUR 12 AND SO ON WITHOUT END"])
@pytest.mark.parametrize("code", [DE, "DE89 3704 0044 0532 0130 00", NO, BE, FR])
def test_what_follows_does_not_hide_a_number(code, tail):
    assert found("IBAN " + code + tail) == [code]


def test_numbers_in_a_row_and_after_a_false_start():
    assert found(f"{NO} {BE}") == [NO, BE] and found(f"{DE} {FR} {NO} X") == [DE, FR, NO]
    assert found(f"XX12 ABCD {DE} BIC") == [DE]


def test_wrong_numbers_stay_out():
    assert found("IBAN DE89370400440532013001 BIC COBADEFFXXX") == [] and found(DE + "BIC") == [] and found("A" + DE) == []
    assert found("AB12 " * 40_000) == []


def test_country_lengths():
    assert len({c for c in pii.IBAN_LENGTHS}) > 80 and all(15 <= n <= 34 for n in pii.IBAN_LENGTHS.values())
    assert all(pii.IBAN_LENGTHS[c[:2]] == len(c) for c in (DE, NO, BE, FR))
