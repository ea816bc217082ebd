"""Added kinds of personal data against a version that tries every start and every end, without patterns."""

import random

from ledgerloom.llm import pii

ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
UPPER, DIGITS = ALNUM[:26], ALNUM[52:]


def remainder(code):
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def bounded(text, a, b, also=""):
    near = ALNUM + also
    return (a == 0 or text[a - 1] not in near) and (b == len(text) or text[b] not in near)


def plain_ibans(text):
    found, a = [], 0
    while a < len(text):
        best = 0
        for b in range(a + 15, min(len(text), a + 70) + 1):
            part = text[a:b]
            code = part.replace(" ", "")
            if "  " in part or part[-1] == " " or not bounded(text, a, b) or any(c not in UPPER + DIGITS for c in code):
                continue
            if code[:2].isalpha() and code[2:4].isdigit() and " " not in part[:4] and pii.IBAN_LENGTHS.get(code[:2]) == len(code) and remainder(code) == 1:
                best = b
        if best:
            found.append((a, best))
        a = best or a + 1
    return found


def plain_numbers(text, kind):
    found, a = [], 0
    size = 13 if kind == "card13" else 11
    while a + size <= len(text):
        part = text[a : a + size]
        if kind == "card13":
            digits = [int(c) for c in reversed(part)] if all(c in DIGITS for c in part) else []
            doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)]
            fits = part[0] == "4" and bool(digits) and sum(doubled) % 10 == 0
        else:
            x = part.split("-")
            fits = [len(p) for p in x] == [3, 2, 4] and all(c in DIGITS for p in x for c in p) and x[0] not in ("000", "666") and x[0][0] != "9" and x[1] != "00" and x[2] != "0000"
        if fits and bounded(text, a, a + size, "-"):
            found.append((a, a + size))
            a += size
        else:
            a += 1
    return found


def plain(text):
    base = [(s.start, s.end) for s in pii.find(text) if s.kind in pii.BASE]
    taken, out = list(base), []
    for kind, (_, score, words) in pii.ADDED.items():
        for a, b in plain_ibans(text) if kind == "iban" else plain_numbers(text, kind):
            told = any(w in text[max(0, a - pii.CONTEXT_CHARS) : a].lower() for w in words)
            if score + pii.CONTEXT_GAIN * told >= pii.THRESHOLD and all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                out.append((kind, a, b))
    return sorted(out, key=lambda s: (s[1], s[0]))


def made(rng):
    country = rng.choice(sorted(pii.IBAN_LENGTHS))
    rest = "".join(rng.choice(UPPER + DIGITS) for _ in range(pii.IBAN_LENGTHS[country] - 4))
    check = next(c for c in (f"{k:02}" for k in range(100)) if remainder(country + c + rest) == 1)
    if rng.random() < 0.2:
        check = f"{(int(check) + 1) % 100:02}"
    code = country + check + rest
    return " ".join(code[k : k + 4] for k in range(0, len(code), 4)) if rng.random() < 0.5 else code


def test_added_kinds_against_a_plain_search():
    rng = random.Random(6)
    number = lambda n: "".join(rng.choice(DIGITS) for _ in range(n))
    seen = set()
    for _ in range(600):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            kind = rng.randrange(9)
            parts.append(
                made(rng) if kind < 2 else "4" + number(12) if kind < 4 else f"{number(3)}-{number(2)}-{number(4)}" if kind == 4
                else rng.choice(["bank account", "my visa card", "SSN", "social security number", "konto"]) if kind < 7 else rng.choice(["and", "OK", "A1", "x@y.org", "+49 30 1234567", "7", "é"])
            )
        text = rng.choice([" ", ", ", ": "]).join(parts)
        got = sorted(((s.kind, s.start, s.end) for s in pii.find(text) if s.kind in pii.ADDED), key=lambda s: (s[1], s[0]))
        assert got == plain(text), text
        seen |= {k for k, _, _ in got}
    assert seen == set(pii.ADDED)
