"""Labelled URLs to train the filter on: written out by rules over forms that addresses of articles and of spam commonly have, so that the label
(1: unwanted) is known. Deterministic; ``URLS`` bounds their number."""

from __future__ import annotations

import random

URLS = 12_000
_SYLLABLES = "an ar ba be ca ce co da de di en er es fa fi ga ge in is ka la le li lo ma mi mo na ne no on or pa pe po ra re ri ro sa se si so ta te th ti to un ur va ve vi st sh tion".split()
_LANGS = "en de fr es it pt nl pl".split()
_SECTIONS = "news blog article articles posts wiki docs science culture sport politics story archive questions help research".split()
# Fixed: words that stand often in addresses of spam, gambling, adult, counterfeit and tracking sites.
_UNWANTED = (
    "casino poker slots bet bets betting jackpot lottery win winner bonus free cheap discount deals pills pharma viagra cialis meds diet loan loans credit payday crypto bitcoin porn sex xxx adult "
    "cams dating escort replica watches outlet ads ad adserver track tracker tracking click clicks popup banner spam farm traffic seo crack keygen warez torrent download earn money rich hot girls"
).split()
_PLAIN = "daily city open green blue north river home world library museum school garden music travel health kitchen history letters journal times post review institute university society press free hot best home".split()
_GOOD_ENDS = "com org net de fr es co.uk edu gov example.com example.org example.net it nl info io".split()
_BAD_ENDS = "com net info xyz top click biz loan win bid online site example.com example.org example.net ru tk org".split()


def labelled_url(seed: int) -> tuple[str, int]:
    r = random.Random(seed)
    bad = r.random() < 0.4

    def word(low: int = 1, high: int = 3) -> str:
        return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(low, high)))

    def slug(low: int, high: int) -> str:
        return "-".join(word() for _ in range(r.randint(low, high)))

    def digits(low: int, high: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(r.randint(low, high)))

    front = r.choice(("", "", "www.", "www.", "blog.", "m.", "news.", "en."))
    if bad:
        kind = r.random()
        if kind < 0.6:
            own = [r.choice(_UNWANTED), r.choice((*_UNWANTED, word(), word()))]
            r.shuffle(own)
            name = r.choice(("-", "-", "", "-")).join(own if r.random() < 0.85 else [*own, r.choice(_UNWANTED)])
            name += digits(1, 3) if r.random() < 0.2 else ""
        elif kind < 0.8:
            name = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789-") for _ in range(r.randint(10, 28))).strip("-") or "x0"
        elif kind < 0.9:
            name, front = ".".join(str(r.randint(1, 254)) for _ in range(4)), ""
        else:
            name = f"{word(2, 4)}{digits(2, 6)}"
        host = front + name + ("" if kind >= 0.8 and kind < 0.9 else "." + r.choice(_BAD_ENDS))
        path = r.choice(
            (f"/{r.choice(_LANGS)}/{digits(1, 6)}", f"/{digits(5, 12)}/{word()}.php", f"/{slug(4, 9)}.html", "/", "", f"/{word()}/{word()}/{word()}/{digits(3, 9)}/{word()}", f"/go/{digits(8, 20)}", f"/{r.choice(_UNWANTED)}/{slug(1, 3)}")
        )
    else:
        name = r.choice((word(2, 4), word(2, 4), word(1, 2) + r.choice(_PLAIN), r.choice(_PLAIN) + r.choice(_PLAIN), f"{word(1, 3)}-{r.choice(_PLAIN)}" if r.random() < 0.4 else word(2, 3)))
        host = front + name + "." + r.choice(_GOOD_ENDS)
        path = r.choice(
            (f"/{r.choice(_LANGS)}/{digits(1, 6)}", f"/{r.choice(_LANGS)}/{digits(1, 6)}.html", f"/{r.choice(_SECTIONS)}/{slug(2, 7)}", f"/{r.choice(_SECTIONS)}/20{digits(2, 2)}/{r.randint(1, 12):02d}/{slug(2, 8)}.html",
             f"/{word()}", "/", f"/{r.choice(_SECTIONS)}/{digits(3, 8)}/", f"/{r.choice(_LANGS)}/{slug(1, 4)}/")
        )
    path += "/" if r.random() < 0.1 and path and not path.endswith("/") else ""
    plain = ("", "", "", "", "?utm_source=feed", "?page=2&ref=x", f"?id={digits(1, 5)}", "#top")
    loud = (f"?aff={digits(3, 9)}&clickid={digits(8, 20)}&sub={word()}&src={word()}", "?" + "&".join(f"{word(1, 1)}={word()}{digits(0, 8)}" for _ in range(r.randint(3, 9))), f"?redirect=http%3A%2F%2F{word()}.{r.choice(_BAD_ENDS)}%2F{digits(3, 8)}")
    end = r.choice(loud if bad and r.random() < 0.35 else plain)
    return f"{r.choice(('http', 'https'))}://{host}{path}{end}", int(bad)


def labelled_urls(count: int = URLS) -> list[tuple[str, int]]:
    return [labelled_url(seed) for seed in range(count)]
