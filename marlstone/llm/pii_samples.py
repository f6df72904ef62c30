"""Labelled character spans for training the personal-data tagger.

A seeded generator writes prose of invented words, with tables, junk and
numbers that are not personal, and puts personal data into it in plain and in
disguised forms. The spans it put in are the labels; no corpus row is used.
"""

from __future__ import annotations

import random

import numpy as np

from .lstm_crf import PAD, classes

KINDS = ("email", "ip", "card", "phone")
# Syllables, in the order of the four languages they imitate.
SYLLABLES = (
    "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve "
    "er en ch ei ie un ge be ung keit lich sch ß ü ö ä der die ver zu "
    "de la os es ci ar as ción mente ñ í ó ra do que en el "
    "le re en on ai eau é è ê ç tion ment que ou an oi eux tre"
).split(" ")
PUNCTUATION = ("", "", "", "", "", "", "", ",", ".", ".", ";", "!", "?", " |", "***", "###", "%%%", "$$$", "&&&")


def _word(r: random.Random) -> str:
    w = "".join(r.choice(SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))
    return w.capitalize() if r.random() < 0.12 else w


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _luhn_tail(body: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _email(r: random.Random) -> str:
    user = _word(r).lower() + r.choice(("", ".", "_", "-", "+")) + r.choice((_word(r).lower(), _digits(r, 2)))
    host = [r.choice((_word(r).lower(), "mail" + _digits(r, 1), "example")), r.choice(("com", "org", "net", "example.com", "de", "fr", "co.uk"))]
    style = r.random()
    if style < 0.7:
        return f"{user}@{'.'.join(host)}"
    at, dot = r.choice(((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", ".")))
    return f"{user}{at}{host[0]}{dot}{host[1]}"


def _ip(r: random.Random) -> str:
    return ".".join(str(r.randrange(256)) for _ in range(4))


def _card(r: random.Random) -> str:
    body = r.choice("3456") + _digits(r, r.choice((13, 14, 14, 14)))
    number = body + _luhn_tail(body)
    sep = r.choice(("", "", " ", "-"))
    return sep.join(number[i : i + 4] for i in range(0, len(number), 4))


def _phone(r: random.Random) -> str:
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice((f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+{_digits(r, 2)} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}"))


def _decoy(r: random.Random) -> str:
    """Numbers and codes that are nobody's."""
    return r.choice(
        (
            str(r.randrange(1900, 2100)), _digits(r, r.randrange(1, 7)), f"${_digits(r, 3)}.{_digits(r, 2)}", f"v{r.randrange(9)}.{r.randrange(20)}.{r.randrange(20)}",
            f"Version {r.randrange(9)}.{r.randrange(9)}", f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', f"{_word(r)}-{_word(r)}", f"({_word(r)})",
            f"20{_digits(r, 2)}-{_digits(r, 2)}-{_digits(r, 2)}", f"{_digits(r, 2)}:{_digits(r, 2)}", f"http://{_word(r)}.example.org/{_digits(r, 3)}", f"{_digits(r, 2)}%", f"{_word(r)} at {_word(r)}",
            _digits(r, r.randrange(20, 30)), f"#{_digits(r, 5)}", f"{_digits(r, 1)},{_digits(r, 3)},{_digits(r, 3)}",
            " ".join([r.choice((_word(r), "at", "and"))] * r.randrange(2, 9)), f"{_word(r)} at {_word(r)} {_word(r)}.", f"CC BY-NC {r.randrange(5)}.0.",
        )
    )


MAKERS = (_email, _ip, _card, _phone)


def labelled_windows(count: int, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes and of labels (0 outside, 1.. in the order of KINDS)."""
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(count):
        text, spans = "", []
        rate = r.choice((0.0, 0.0, 0.05, 0.12, 0.25))
        while len(text) < length:
            p = r.random()
            if p < rate:
                k = r.randrange(4)
                s = MAKERS[k](r)
                spans.append((len(text), len(text) + len(s), k + 1))
                text += s + r.choice(("", "", ",", ".", "***", "&&&")) + " "
            elif p < rate + 0.06:
                text += _decoy(r) + r.choice((" ", ". ", ", "))
            else:
                text += _word(r) + r.choice(PUNCTUATION) + ("\n" if r.random() < 0.04 else " ")
        y = np.zeros(len(text), np.uint8)
        for a, b, k in spans:
            y[a:b] = k
        cut = r.randrange(max(1, len(text) - length))
        xs.append(classes(text)[cut : cut + length])
        ys.append(y[cut : cut + length])
        if r.random() < 0.1:
            n = r.randrange(length)
            xs[-1][n:] = PAD
            ys[-1][n:] = 0
    return np.stack(xs), np.stack(ys)
