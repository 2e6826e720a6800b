"""URL filter: all glob rules at once by a multiword Shift-And automaton."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host (and, with ``subdomains``, all hosts below it) and a path glob.

    In globs, ``*`` is any run and ``?`` any one byte; in hosts neither is ``/``.
    """

    verdict: str
    host: str
    path: str
    subdomains: bool = True

    @property
    def name(self) -> str:
        return self.host + self.path.removesuffix("*")

    def globs(self) -> list[tuple[str, str]]:
        return [(self.host, self.path)] + [("*." + self.host, self.path)] * self.subdomains


#: Rules of the registered query, then what is blocked where none of them fits.
RULES = [Rule("allow", "org", "/*"), Rule("block", "example.org", "/es/*"), Rule("block", "example.org", "/en/1*"), Rule("allow", "com", "/fr/*"), Rule("block", "com", "/de/*")]
#: Words that mark a host, by kind of site; a parameter like the rules.
BLOCKED_WORDS = {
    "adult": ["adult", "porn", "xxx", "escort", "camgirl", "hentai", "nsfw", "erotic"],
    "gambling": ["casino", "jackpot", "roulette", "sportsbet", "blackjack", "lottery"],
    "piracy": ["torrent", "warez", "keygen", "freemovies", "crackedapk"],
    "malware": ["phishing", "malware", "botnet", "cryptojack", "adware"],
    "spam": ["linkfarm", "replicawatch", "cheappills", "payday-loan", "seo-backlink", "essaymill"],
}
BLOCKED = [Rule("block", f"*{w}*", "*", False) for words in BLOCKED_WORDS.values() for w in words]


class ShiftAnd:
    """Globs as bits: state i of a glob is "i literals matched"; a star is a loop on its state."""

    def __init__(self, globs: list[tuple[str, str]]):
        n = sum(len(h.replace("*", "").encode()) + len(p.replace("*", "").encode()) + 1 for h, p in globs)
        self.words = max(1, -(-n // 64))
        step, loop = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.start, self.final, at = np.zeros(self.words, np.uint64), [], 0
        bit = lambda i: (i // 64, np.uint64(1 << (i % 64)))
        no_slash = [c for c in range(256) if c != ord("/")]
        for host, path in globs:
            w, b = bit(at)
            self.start[w] |= b
            for text, some in ((host, no_slash), (path, list(range(256)))):
                for c in text.encode():
                    w, b = bit(at)
                    if c == ord("*"):
                        loop[some, w] |= b
                        continue
                    at += 1
                    w, b = bit(at)
                    step[some if c == ord("?") else [c], w] |= b
            self.final.append(bit(at))
            at += 1
        self.step, self.loop, self.few = step, loop, 8
        whole = lambda masks: [int.from_bytes(m.tobytes(), "little") for m in masks.astype("<u8")]
        self.whole_step, self.whole_loop = whole(step), whole(loop)

    def _rest(self, state: np.ndarray, text: bytes) -> np.ndarray:
        s, step, loop = int.from_bytes(state.astype("<u8").tobytes(), "little"), self.whole_step, self.whole_loop
        for c in text:
            s = (s << 1) & step[c] | s & loop[c]
        return np.frombuffer(s.to_bytes(8 * self.words, "little"), "<u8")

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Texts x globs. All globs advance together, one byte of every text at a time."""
        n = len(texts)
        size = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-size, kind="stable")
        size, data = size[order], np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, n))
        at = (ends - np.fromiter(map(len, texts), np.int64, n))[order]
        state = np.tile(self.start, (n, 1))
        for p in range(int(size[0]) if n else 0):
            m = int(np.searchsorted(-size, -p, side="left"))  # texts longer than p
            if m <= self.few:  # few long ones: each alone from here on, its masks as whole numbers
                for i in range(m):
                    state[i] = self._rest(state[i], data[at[i] + p : at[i] + size[i]].tobytes())
                break
            c, s = data[at[:m] + p], state[:m]
            moved = s << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:m] = (moved & self.step[c]) | (s & self.loop[c])
        out = np.empty((n, len(self.final)), bool)
        for g, (w, b) in enumerate(self.final):
            out[order, g] = (state[:, w] & b) != 0
        return out


def rules_of(table: DataFrame, most: int = 10_000) -> list[Rule]:
    """Rules from a table of ``verdict, host, path, subdomains``; every task carries them all, so there may be ``most`` at most."""
    rows = table.select("verdict", "host", "path", "subdomains").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return [Rule(*r) for r in rows]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UP, _LOW)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] = RULES, otherwise: list[Rule] = BLOCKED, default: str = "allow") -> DataFrame:
    """``(id, host, path, rule, verdict)``, one row per row of ``df``.

    The canonical URL is host and path. Of the rules that fit, the longest
    decides (the earlier of equals). Where none fits, rule is null and a rule of
    ``otherwise`` decides, or else ``default``. A null url or one without
    ``://`` has an empty host and path and fits no rule with a host. Urls of any
    length are judged whole; repeated rows are judged row by row; an empty table
    gives no rows. ``rules`` and ``otherwise`` can be tables of the user's (see ``rules_of``).
    """
    ranked = sorted(rules, key=lambda r: -len(r.name.encode()))
    every = [*ranked, *otherwise]
    owner = np.array([i for i, r in enumerate(every) for _ in r.globs()])
    automaton = ShiftAnd([g for r in every for g in r.globs()])
    names = [r.name for r in ranked]

    def run(batches):
        for b in batches:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            hit = automaton.match([(h + p).encode("utf-8", "surrogatepass") for h, p in zip(hosts, paths)])
            fits = np.zeros((len(hosts), len(every) + 1), bool)
            for g, i in enumerate(owner):
                fits[:, i] |= hit[:, g]
            fits[:, -1] = True
            best = fits.argmax(axis=1)
            rule = [names[i] if i < len(names) else None for i in best]
            verdict = [every[i].verdict if i < len(every) else default for i in best]
            yield pa.record_batch([b.column("id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    src = df.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


ORACLE = """
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/'
  END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN BLOCKED_HOST THEN 'block' ELSE 'allow' END AS verdict
FROM r
""".replace("BLOCKED_HOST", " OR ".join(f"host LIKE '%{w}%'" for words in BLOCKED_WORDS.values() for w in words))
