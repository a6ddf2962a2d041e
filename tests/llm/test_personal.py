"""The personal-data model on texts that its generator did not make."""

import pytest

from tallyhouse.llm import pii

PHONES = [
    ("phone 030 1234567 please", "030 1234567"), ("tel 0171/1234567", "0171/1234567"),
    ("please call (415) 555-0132 or write", "(415) 555-0132"), ("mobile 07911 123456 now", "07911 123456"),
    ("fax: 01 42 68 53 00", "01 42 68 53 00"), ("reach us at 415-555-0132 daily", "415-555-0132"),
    ("call 0800 123 4567 now", "0800 123 4567"), ("tel 020 7946 0958", "020 7946 0958"),
]
NONE = [
    "transfer to DE89 3704 0044 0532 0130 00 today", "IBAN DE89 3704 0044 0532 0130 00", "my number is 123-45-6789 there",
    "SSN 123-45-6789", "ISBN 978-3-16-148410-0", "see 978-3-16-148410-0 for it", "order 12345-67890 was sent",
    "your order number 4711-0815 is late", "server 192.168.0.300 is down", "the card 4111 1111 1111 1112 was refused",
    "on 2024-05-17 at 10:30", "born 17.05.2024 in town", "costs 1,234,567 euros", "released 3.11.4 and 2.0.17",
]


@pytest.mark.parametrize("text, number", PHONES)
def test_national_phone_numbers_are_found(text, number):
    assert [(text[s:e], kind, base) for s, _, e, kind, base in pii.all_spans(text, pii.trained())] == [(number, "phone", False)]


@pytest.mark.parametrize("text", NONE)
def test_other_numbers_are_left_alone(text):
    assert pii.all_spans(text, pii.trained()) == []


def test_precision_and_recall_of_every_kind():
    model, counts = pii.trained(), {label: [0, 0, 0] for label in range(1, 5)}
    for atoms, gold in pii.examples(200, seed=41):
        best = set(model.best(atoms))
        for label, own in counts.items():
            found, wanted = ({span for span in spans if span[1] == label} for spans in (best, gold))
            own[0], own[1], own[2] = own[0] + len(found & wanted), own[1] + len(found), own[2] + len(wanted)
    for right, found, wanted in counts.values():
        assert right >= 0.95 * found and right >= 0.95 * wanted
