"""Hosts and registered domains of URLs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Public suffixes of two labels that are recognised without a list, besides every single last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "co.jp", "ne.jp", "or.jp", "com.au", "net.au", "org.au", "com.br", "com.cn", "co.in", "co.nz", "co.za", "co.kr")


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(found)


def parse_suffixes(lines: Iterable[str]) -> dict[str, str]:
    """Rules of a public suffix list: each suffix with ``plain``, ``wildcard`` (any one label before it) or ``exception``."""
    out = {}
    for line in lines:
        rule = line.split("//")[0].split()
        if not rule:
            continue
        name = rule[0].strip(".").lower()
        if name.startswith("!"):
            out[name[1:]] = "exception"
        elif name.startswith("*."):
            out[name[2:]] = "wildcard"
        else:
            out.setdefault(name, "plain")
    return out


def public_suffix_labels(h: Column, suffixes: Mapping[str, str]) -> Column:
    """How many labels of a host are its public suffix: of the rules that fit the longest, an exception first, else the last label."""
    n = F.size(F.split(h, r"\."))
    by: dict[tuple[str, int], list[str]] = {}
    for name, kind in suffixes.items():
        by.setdefault((kind, name.count(".") + 1), []).append(name)
    deepest = max((depth for _, depth in by), default=0) + 1

    def listed(kind: str, depth: int) -> Column:
        """Whether the last labels are a rule: each list is of one depth, so all of them are one look into a set for each label."""
        names = by.get((kind, depth))
        return F.substring_index(h, ".", -depth).isin(names) if names else F.lit(False)

    out = F.lit(1)
    for k in range(1, deepest + 1):
        if ("plain", k) in by or ("wildcard", k - 1) in by:
            out = F.when((n >= k) & (listed("plain", k) | listed("wildcard", k - 1)), F.lit(k)).otherwise(out)
    for k in range(1, deepest + 1):
        if ("exception", k) in by:
            out = F.when((n >= k) & listed("exception", k), F.lit(k - 1)).otherwise(out)
    return out


def registered_domain(url: Column, suffixes: Mapping[str, str] | None = None) -> Column:
    """Public suffix and one label; else the host; else the URL itself. ``suffixes`` are rules of :func:`parse_suffixes`."""
    h = host(url)
    suffixes = dict.fromkeys(TWO_LABEL_SUFFIXES, "plain") if suffixes is None else suffixes
    labels = public_suffix_labels(h, suffixes)
    n = F.size(F.split(h, r"\."))
    domain = F.array_join(F.slice(F.split(h, r"\."), F.greatest(n - labels, F.lit(1)), F.least(labels + 1, n)), ".")
    return F.when(h == "", F.coalesce(url, F.lit(""))).when(h.rlike(r"^[0-9.]+$"), h).otherwise(domain)
