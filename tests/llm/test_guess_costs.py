"""The guess cost against all cuts, and what is and is not a secret behind a credential word."""

import math
import random

import pytest

from maskwork.llm.secret_scan import DATES, GuessRules, SEPARATORS, SHAPES, find_secrets, guess_cost, is_secret, random_cost

WORDS = ("pass", "word", "ab", "spot", "blue", "state", "https")
RULES = GuessRules(words=WORDS)
ROWS = ["`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz"]
SWAPS = [dict(zip("@4310$57!+", "aaeiossitt")), dict(zip("@43!0$57|1", "aeeiosstll"))]


def step_of(a, b):
    for row in ROWS:
        for way, keys in ((1, row), (-1, row[::-1])):
            if a + b in keys:
                return way
    return 0


def least_over_all_cuts(value):
    n, low = len(value), value.lower()
    each = math.log10(26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value) + 10 * any("0" <= c <= "9" for c in value) + 33 * any(not (c.isascii() and c.isalnum()) for c in value))

    def is_walk(a, b):
        ways = {step_of(low[i], low[i + 1]) for i in range(a, b - 1)}
        return b - a >= 3 and len(ways) == 1 and 0 not in ways

    def part(a, b):
        costs = [(b - a) * each]
        for read in (low, *("".join(swap.get(c, c) for c in low) for swap in SWAPS)):
            if b - a > 1 and read[a:b] in WORDS:
                costs.append(math.log10(WORDS.index(read[a:b]) + 2) + 0.5 * (value[a:b] != low[a:b]) + (read[a:b] != low[a:b]))
        for pattern, cost in (*DATES, *SHAPES):
            m = pattern.match(value, a)
            if m and m.end(1) == b:
                costs.append(cost)
        if is_walk(a, b) and not (a and is_walk(a - 1, b)) and not (b < n and is_walk(a, b + 1)):
            costs.append(math.log10(94 * (b - a)))
        if b == a + 1 and 0 < a and b < n and value[a] in SEPARATORS:
            costs.append(0.0)
        return min(costs)

    costs = {(a, b): part(a, b) for a in range(n) for b in range(a + 1, n + 1)}
    ways = [math.inf] * (1 << (n - 1))
    for mask in range(1 << (n - 1)):
        at = [0, *[i for i in range(1, n) if mask >> (i - 1) & 1], n]
        ways[mask] = sum(costs[a, b] for a, b in zip(at, at[1:])) + RULES.part_cost * (len(at) - 2)
    return min(ways)


def test_cost_is_least_over_all_cuts():
    rng = random.Random(8)
    bits = ["pass", "W0rd", "$pot", "b|ue", "st@te", "2024", "0131", "Jan2024", "qwer", "9876", "-", "_", "x", "K", "#", ".com", "12:45"]
    values = set()
    while len(values) < 60:
        v = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 5)))
        if len(v) <= 11 and not any(v[i : i + k] == v[i + k : i + 2 * k] for k in (1, 2, 3, 4) for i in range(len(v) - 2 * k + 1)):
            values.add(v)
    for v in sorted(values):
        assert abs(guess_cost(v, RULES) - least_over_all_cuts(v)) < 1e-9, v


ORDINARY = "account settings contact your administrator authenticated user only please request here wiki page login".split()
LEARNED = GuessRules(words=(*GuessRules().words, *[f"filler{i}" for i in range(1000)], *ORDINARY))


@pytest.mark.parametrize(
    "text",
    [
        "Login: https://example.com/account/settings",
        "credentials: contact-your-administrator",
        "auth => authenticated_user_only",
        "api key: please-request-one-here",
        "pwd: see-the-wiki-page",
        "The login is 2024-05-06T10:11:12Z today",
        "login: 2024-05-06T10:11:12+02:00",
        "auth: Überflüssig",
        "pwd: /account/settings/page.html",
    ],
)
def test_ordinary_values_are_left_alone(text):
    assert find_secrets(text, LEARNED) == []


@pytest.mark.parametrize("value", ["kX9#vLq2Zp", "Tr0ub4dor!3xK#9z", "f8a03bc1d97e45", "xkqzvwjtrplm", "x7!account?Qz81$", "a8f-93kd-x02m-qq71", "https://example.com/account/kX9#vLq2Zp"])
def test_guessed_values_are_found(value):
    assert is_secret(value, LEARNED, False) and guess_cost(value, LEARNED) <= random_cost(value) + 1e-9
    for text in (f"pwd: {value} ok", f"login => '{value}'", f"passphrase={value}."):
        assert [text[a:b] for k, a, b in find_secrets(text, LEARNED) if k == "guess"] == [value]
