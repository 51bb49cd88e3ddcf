"""Short wordings by which texts name their licence: an opening, then a usual spelling of licence and version.

Names without a version ("the GPL", "a BSD license") decide no licence and are not listed.
"""

from __future__ import annotations

from dataclasses import dataclass

OPENINGS = (
    "licensed under", "licenced under", "licensed under the terms of", "released under", "distributed under",
    "available under", "published under", "provided under", "redistributed under", "shared under", "dual-licensed under",
    "under the terms of", "under the terms and conditions of", "covered by", "governed by", "subject to",
    "subject to the terms of", "license", "licence", "license is", "spdx-license-identifier",
)
# For abbreviations that are also other things.
PLAIN_OPENINGS = ("licensed under", "licenced under", "released under", "distributed under", "license", "licence", "spdx-license-identifier")
ARTICLES = ("", "the ", "a ", "an ")


def _versions(names: tuple[str, ...], version: str, also: tuple[str, ...] = ()) -> list[str]:
    """Spellings of a name with each form of its version."""
    numbers = {version, *also}
    joined = [f"{n} {form}{v}" for n in names for v in sorted(numbers) for form in ("", "v", "v. ", "version ")]
    return joined + [f"version {v} of the {n}" for n in names for v in sorted(numbers)]


def _abbreviated(names: tuple[str, ...], version: str, also: tuple[str, ...] = ()) -> list[str]:
    numbers = sorted({version, *also})
    out = [f"{n}{mark}{v}" for n in names for v in numbers for mark in ("-", "v", "", "-v")] + _versions(names, version, also)
    return out + [f"{x} {word}" for x in out for word in ("license", "licence")]


def _gnu() -> dict[str, list[str]]:
    out = {}
    for short, titles, versions in (
        ("GPL", ("general public license",), (("1.0", "1"), ("2.0", "2"), ("3.0", "3"))),
        ("LGPL", ("lesser general public license", "library general public license"), (("2.0", "2"), ("2.1", "2.1"), ("3.0", "3"))),
        ("AGPL", ("affero general public license",), (("3.0", "3"),)),
        ("GFDL", ("free documentation license",), (("1.1", "1.1"), ("1.2", "1.2"), ("1.3", "1.3"))),
    ):
        names = tuple(f"{gnu}{t}" for t in titles for gnu in ("", "gnu "))
        names += tuple(f"{n} {short}" for n in names)  # GNU General Public License (GPL)
        for version, brief in versions:
            marked = [f"{short}{mark}{v}{more}" for v in {version, brief} for mark in ("-", "v") for more in ("-only", "-or-later", "+")]
            out[f"{short}-{version}"] = _versions(names, version, (brief,)) + _abbreviated((short, f"gnu {short}"), version, (brief,)) + sorted(marked)
    return out


def _creative_commons() -> dict[str, list[str]]:
    out = {}
    for kind, title in (
        ("BY", "attribution"), ("BY-SA", "attribution-sharealike"), ("BY-NC", "attribution-noncommercial"),
        ("BY-ND", "attribution-noderivatives"), ("BY-NC-SA", "attribution-noncommercial-sharealike"),
        ("BY-NC-ND", "attribution-noncommercial-noderivatives"),
    ):
        for version, places in (("1.0", ("generic",)), ("2.0", ("generic",)), ("2.5", ("generic",)), ("3.0", ("unported",)), ("4.0", ("international",))):
            titles = {title, title.replace("noderivatives", "noderivs")}
            titles |= {t.replace("noncommercial", "non-commercial").replace("sharealike", "share-alike") for t in titles}
            titles |= {t.replace("-", " ") for t in titles} | {kind, kind.replace("-", " ")}
            long = [f"creative commons {t} {v}" for t in sorted(titles) for v in (version, f"v{version}")]
            brief = [f"cc {kind} {version}", f"cc-{kind}-{version}", f"cc-{kind} {version}", f"cc {kind.replace('-', ' ')} {version}", f"cc {kind}-{version}"]
            names = long + brief
            names += [f"{n} {place}" for n in names for place in places]
            out[f"CC-{kind}-{version}"] = names + [f"{n} {word}" for n in names for word in ("license", "licence", "public license")]
    return out


def _others() -> dict[str, list[str]]:
    out = {}
    for licence, names, short, version, also in (
        ("Apache-2.0", ("apache license", "apache software license", "apache licence"), ("apache", "asl"), "2.0", ("2",)),
        ("Apache-1.1", ("apache license", "apache software license", "apache licence"), ("apache",), "1.1", ()),
        ("MPL-1.1", ("mozilla public license",), ("mpl",), "1.1", ()),
        ("MPL-2.0", ("mozilla public license",), ("mpl",), "2.0", ("2",)),
        ("EPL-1.0", ("eclipse public license",), ("epl",), "1.0", ("1",)),
        ("EPL-2.0", ("eclipse public license",), ("epl",), "2.0", ("2",)),
        ("CDDL-1.0", ("common development and distribution license",), ("cddl",), "1.0", ("1",)),
        ("CDDL-1.1", ("common development and distribution license",), ("cddl",), "1.1", ()),
        ("EUPL-1.1", ("european union public licence", "european union public license"), ("eupl",), "1.1", ()),
        ("EUPL-1.2", ("european union public licence", "european union public license"), ("eupl",), "1.2", ()),
        ("BSL-1.0", ("boost software license",), ("bsl",), "1.0", ("1",)),
        ("Artistic-1.0", ("artistic license",), ("artistic",), "1.0", ("1",)),
        ("Artistic-2.0", ("artistic license",), ("artistic",), "2.0", ("2",)),
        ("OFL-1.1", ("sil open font license", "open font license"), ("ofl", "sil ofl"), "1.1", ()),
        ("CC0-1.0", ("creative commons zero", "creative commons cc0"), ("cc0",), "1.0", ("1",)),
        ("PSF-2.0", ("python software foundation license",), ("psf",), "2.0", ("2",)),
    ):
        out[licence] = _versions(names, version, also) + _abbreviated(short, version, also)
    out["CC0-1.0"] += ["cc0", "cc0 license", "cc0 1.0 universal", "cc0 1.0 universal license", "creative commons zero v1.0 universal", "creative commons cc0 1.0 universal", "creative commons cc0", "creative commons zero license"]
    out["BSL-1.0"] += ["boost software license"]
    for licence, names in {
        "MIT": ("mit license", "mit licence", "mit/x11 license", "mit expat license", "mit license mit", "expat license"),
        "MIT-0": ("mit-0", "mit-0 license", "mit no attribution license", "mit no attribution"),
        "ISC": ("isc license", "isc licence"),
        "Zlib": ("zlib license", "zlib licence", "zlib/libpng license"),
        "Unlicense": ("unlicense", "unlicense license"),
        "WTFPL": ("wtfpl", "wtfpl license", "do what the fuck you want to public license"),
        "0BSD": ("0bsd", "0bsd license", "bsd zero clause license", "zero-clause bsd license", "zero-clause bsd"),
    }.items():
        out[licence] = list(names)
    for n, words, titles in (("2", "two", ("simplified", "freebsd")), ("3", "three", ("new", "modified", "revised")), ("4", "four", ("original",))):
        names = [f"bsd-{n}-clause", f"bsd {n}-clause", f"bsd {n} clause", f"{n}-clause bsd", f"{n} clause bsd", f"{words}-clause bsd", f"{words} clause bsd"]
        names += ["freebsd" if t == "freebsd" else f"{t} bsd" for t in titles]
        out[f"BSD-{n}-Clause"] = [f"{x}{more}" for x in names for more in ("", " license", " licence", "-style license")[: 3]]
    return out


@dataclass(frozen=True)
class Wordings:
    """A wording is an opening and one of the names behind it, or one of the phrases by itself."""

    openings: tuple[str, ...]
    names: dict[str, list[str]]
    phrases: dict[str, list[str]]


def _wordings() -> Wordings:
    names = {f"{k}-line": sorted({x.lower() for x in v}) for k, v in sorted((_gnu() | _creative_commons() | _others()).items())}
    phrases = {
        k: [f"{x} applies" for x in v if x.endswith(("license", "licence")) or any(c.isdigit() for c in x)]
        for k, v in names.items()
    }
    for licence in ("MIT", "ISC", "Zlib"):
        phrases[f"{licence}-line"] += [f"{o} {article}{licence.lower()}" for o in PLAIN_OPENINGS for article in ("", "the ")]
    return Wordings(tuple(f"{o} {article}".strip() for o in OPENINGS for article in ARTICLES), names, phrases)


WORDINGS = _wordings()
