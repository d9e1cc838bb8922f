"""Labelled texts from which the detector of personal data learns: made by rule from a fixed seed, whatever the corpus.

Every text holds one thing that a generator proposes.  Positives are personal data in forms that the kinds' own
patterns miss; negatives look alike but are something else: versions, serial and order numbers, times, sums,
section numbers, handles, and prose around the words "at" and "dot".  No label follows from a kind's check."""
from __future__ import annotations

import random

#: Parts of the texts.
NAMES = "anna bob carla dmitri elena farid grace hugo ines jonas kira liam mona nils olga paul rosa sven tara umar vera yusuf zoe".split()
HOSTS = "example mailbox northwind acme webpost fastnet harbor stellar campus orchard citymail lakeside granite".split()
TOPS = "com org net de fr uk io edu info eu".split()
FILLER = ("the and we they then later report meeting river table number of a this some with before after during house paper green new old "
          "people said that market light year week it is was for on by from").split()
VERBS = "met looked stared arrived stopped worked waited laughed stayed aimed glanced".split()
NOUNS = "noon home night this work dawn school once first least last all lunch work".split()
ENDS = "The and then We it next The so but they He She".split()
EMAIL_CUES = ["mail", "contact", "write to", "e-mail:", "email", "mail me:", "contact us:", "my mail is"]
PHONE_CUES = ["call", "phone", "tel", "mobile", "fax", "phone:", "call me on", "tel."]
CARD_CUES = ["card", "visa", "credit card", "pay with", "card no", "card:"]
IP_CUES = ["server", "host", "ip", "addr", "ip:", "from host"]
THINGS = ["serial", "part", "order", "invoice", "ticket", "model", "item no", "batch", "ref", "article", "isbn", "lot"]


def _words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(FILLER) for _ in range(n))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _three(rng: random.Random, mark: str) -> str:
    return mark.join((_digits(rng, 3), _digits(rng, 3), _digits(rng, 4)))


def _positive(rng: random.Random, kind: str) -> tuple[str, str]:
    """(cue, span)."""
    if kind == "email":
        who = rng.choice(NAMES) + rng.choice(["", "." + rng.choice(NAMES), str(rng.randrange(100)), "_" + rng.choice(NAMES)])
        host, top = rng.choice(HOSTS), rng.choice(TOPS)
        bare, spelt, one, two = f"{who}@{host}", f"{who} at {host} dot {top}", f"{who}(at){host}(dot){top}", f"{who}[at]{host}[dot]{top}"
        span = rng.choice([bare, spelt, one, two])
        return rng.choice(EMAIL_CUES) if span in (bare, spelt) or rng.random() < 0.5 else _words(rng, 1), span
    if kind == "phone":
        local = rng.choice([_three(rng, "-"), _three(rng, " "), _three(rng, "."), f"({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}"])
        return rng.choice(PHONE_CUES), local
    if kind == "card":
        mark = rng.choice([".", "/", "  ", "_"])
        return rng.choice(CARD_CUES), mark.join(rng.choice("3456") + _digits(rng, 3) if k == 0 else _digits(rng, 4) for k in range(4))
    mark = rng.choice(["[.]", "(.)"])
    return rng.choice(IP_CUES), mark.join(str(rng.randrange(1, 255)) for _ in range(4))


def _negative(rng: random.Random, kind: str) -> tuple[str, str]:
    if kind == "email":
        return _words(rng, 1), rng.choice([
            f"{rng.choice(VERBS)} at {rng.choice(NOUNS)} dot {rng.choice(ENDS)}", f"{rng.choice(VERBS)} at {rng.choice(FILLER)} dot {rng.choice(ENDS)}",
            f"{rng.randrange(1, 99)}@{rng.randrange(1, 99)}", f"{rng.choice('abcxyz')}@{rng.choice('abcxyz')}", f"{rng.choice(FILLER)}@v{rng.randrange(9)}"])
    if kind == "phone":
        return rng.choice([rng.choice(THINGS), rng.choice(FILLER), ""]), rng.choice([
            _three(rng, "-"), _three(rng, "."), _three(rng, " "), f"+{_digits(rng, 1)} {_digits(rng, 2)}", f"+{_digits(rng, 2)}.{_digits(rng, 3)}",
            f"+{_digits(rng, 9)}-{_digits(rng, 9)}"])
    if kind == "card":
        return rng.choice([rng.choice(THINGS), rng.choice(FILLER), "total", "id"]), rng.choice([
            _digits(rng, rng.randrange(8, 24)), f"{_digits(rng, 4)}-{_digits(rng, 2)}-{_digits(rng, 2)} {_digits(rng, 2)}", _digits(rng, 4) + " " + _digits(rng, 4),
            ".".join(_digits(rng, 4) for _ in range(4)), "/".join(_digits(rng, 4) for _ in range(4)), " ".join(_digits(rng, 5) for _ in range(4))])
    return rng.choice(["version", "section", "release", "v", "build", "chapter", rng.choice(FILLER)]), rng.choice([
        f"{rng.randrange(256, 999)}.{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(99)}", ".".join(_digits(rng, rng.randrange(3, 6)) for _ in range(4)),
        f"{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(2000, 2030)}.{rng.randrange(300, 999)}", "[.]".join(_digits(rng, 1) for _ in range(4))])


def examples(kinds: tuple[str, ...], each: int, seed: int = 17) -> list[tuple[str, str, int, int, bool]]:
    """(text, kind, start, end, personal): ``each`` texts of each kind and label, always the same."""
    rng = random.Random(seed)
    out = []
    for kind in kinds:
        for personal in (True, False):
            for _ in range(each):
                cue, span = (_positive if personal else _negative)(rng, kind)
                before = " ".join(x for x in (_words(rng, rng.randrange(0, 6)), cue) if x)
                start = len(before) + 1 if before else 0
                text = (before + " " if before else "") + span + rng.choice([" ", ", ", ". ", ""]) + _words(rng, rng.randrange(0, 5))
                out.append((text, kind, start, start + len(span), personal))
    return out
