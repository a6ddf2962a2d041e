"""Secrets anywhere in reach of a context word, on both sides, with and without digits."""

import random

from tallyhouse.llm import secrets

SIGNS = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789"
LETTERS = SIGNS[:-8]


def _novel(scanner, text):
    return [text[s:e] for s, _, e, k in scanner.spans(text) if k == "novel"]


def test_held_out_keys_in_reach_on_both_sides():
    rng, scanner = random.Random(17), secrets.Scanner(secrets.Novelty())
    filler = "it is to be sent with the rest of that for you " * 2
    for signs in (SIGNS, LETTERS):
        for gap in (1, 20, 33, 40, 47):
            behind = before = 0
            for _ in range(40):
                key = "".join(rng.choices(signs, k=32))
                between = " " + filler[: gap - 2] + " " if gap > 1 else " "
                assert len(between) == gap
                behind += _novel(scanner, f"the bearer{between}{key} now") == [key]
                before += _novel(scanner, f"now {key}{between}bearer it") == [key]
            assert behind >= 38 and before >= 38, (signs, gap, behind, before)


def test_letter_only_identifiers_are_mostly_no_keys():
    rng, scanner = random.Random(18), secrets.Scanner(secrets.Novelty())
    words = "user name client config value result buffer index request response session table".split()
    alarms = sum(bool(_novel(scanner, f"curl with bearer {'_'.join(rng.choices(words, k=4))} now")) for _ in range(200))
    assert alarms <= 20  # one in ten; README has the measured share


def test_strings_out_of_reach_and_long_runs():
    scanner = secrets.Scanner(secrets.Novelty())
    key = "x9Kq2LmZ81vTy7PwQ4sRb6Nc"
    far = " the " * 10
    assert _novel(scanner, f"{key}{far}bearer") == [] and _novel(scanner, f"bearer{far}{key}") == []
    assert _novel(scanner, f"{key} token {key[::-1]} token") == [key, key[::-1]]
    assert _novel(scanner, "a" * 50_000 + " token " * 2000) == []
