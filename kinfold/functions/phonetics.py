"""Phonetic codes whose rules depend on context, as Arrow-batched functions over distinct letters of a name."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cached_property

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.functions.transforms import Transform


def cologne(s: str) -> str:
    """Cologne phonetics: digits by letter and neighbours, runs once, zeros only in front."""
    s = s.upper().replace("Ä", "A").replace("Ö", "O").replace("Ü", "U").replace("ß", "S").replace("SS", "SS")
    s = re.sub(r"[^A-Z]", "", unicodedata.normalize("NFD", s))
    code = []
    for i, c in enumerate(s):
        before, after = s[i - 1] if i else "", s[i + 1] if i + 1 < len(s) else ""
        if c in "AEIJOUY":
            k = "0"
        elif c == "H":
            k = "-"  # no sound of its own, but it keeps equal ones apart
        elif c == "B" or (c == "P" and after != "H"):
            k = "1"
        elif c in "DT":
            k = "8" if after and after in "CSZ" else "2"
        elif c in "FPVW":
            k = "3"
        elif c in "GKQ":
            k = "4"
        elif c == "C":
            hard = "AHKLOQRUX" if i == 0 else "AHKOQUX"
            k = "4" if after and after in hard and before not in ("S", "Z") else "8"
        elif c == "X":
            k = "8" if before and before in "CKQ" else "48"
        elif c == "L":
            k = "5"
        elif c in "MN":
            k = "6"
        elif c == "R":
            k = "7"
        else:
            k = "8"
        code.append(k)
    digits = re.sub(r"(.)\1+", r"\1", "".join(code)).replace("-", "")
    return digits[:1] + digits[1:].replace("0", "")


# Fixed values of the public algorithm: name particles, and the number of phonemes kept at most.
PARTICLES = ("da", "dal", "de", "del", "dela", "de la", "della", "des", "di", "do", "dos", "du", "van", "von")
MOST_PHONEMES = 20

_RULES_AT = "org/apache/commons/codec/language/bm/"
_texts: dict[str, str] = {}


def _rule_texts() -> dict[str, str]:
    """The rule tables for names of any origin, as they come with Spark's own libraries; read on the driver once."""
    if not _texts:
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError("Beider-Morse codes need a session, whose libraries hold the rule tables")
        jvm = spark.sparkContext._jvm
        loader = jvm.java.lang.Class.forName("org.apache.commons.codec.language.bm.BeiderMorseEncoder").getClassLoader()

        def read(name: str) -> str:
            stream = loader.getResourceAsStream(f"{_RULES_AT}{name}.txt")
            return bytes(stream.readAllBytes()).decode("utf-8")

        todo = ["gen_lang", "gen_languages", "gen_approx_common"]
        for lang in [x for _, x in _lines(read("gen_languages"))] + ["any"]:
            todo += [f"gen_rules_{lang}", f"gen_approx_{lang}"]
        while todo:
            name = todo.pop()
            if name not in _texts:
                _texts[name] = read(name)
                todo += [x.split()[1] for _, x in _lines(_texts[name]) if x.startswith("#include")]
    return _texts


def _lines(text: str) -> list[tuple[int, str]]:
    """Numbered lines that hold something, without comments."""
    out, inside = [], False
    for n, line in enumerate(text.splitlines()):
        if inside:
            inside = not line.rstrip().endswith("*/")
        elif line.lstrip().startswith("/*"):
            inside = not line.rstrip().endswith("*/")
        elif bare := line.split("//")[0].strip():
            out.append((n, bare))
    return out


#: Languages of a phoneme: a set, or None for any.
Languages = frozenset | None


def _both(a: Languages, b: Languages) -> Languages:
    return b if a is None else a if b is None else a & b


def _context(rx: str) -> Callable[[str], bool]:
    """Test of what stands beside a pattern. The encoder that made these tables known reads contexts without a bracket as plain text, and a single bracket as a list of characters; so does this."""
    start, end = rx.startswith("^"), rx.endswith("$")
    inner = rx[start : len(rx) - end]
    if "[" not in inner:
        if start and end:
            return lambda x: x == inner
        return (lambda x: x.startswith(inner)) if start else (lambda x: x.endswith(inner))
    if inner[0] == "[" and inner[-1] == "]" and "[" not in inner[1:-1]:
        listed, wanted = inner[1:-1].removeprefix("^"), inner[1] != "^"
        if start and end:
            return lambda x: len(x) == 1 and (x in listed) == wanted
        place = 0 if start else -1
        return lambda x: bool(x) and (x[place] in listed) == wanted
    compiled = re.compile(rx)
    return lambda x: compiled.search(x) is not None


class BeiderMorse:
    """Beider-Morse codes of names of any origin, approximate rules: the phoneme strings, joined by bars.

    The languages that a spelling allows are guessed, its letters become phonemes by the rules of that language (of any,
    if several are left), and two sets of final rules level what sounds alike. The rule tables travel with the encoder.
    """

    def __getstate__(self) -> dict:
        return {"texts": dict(_rule_texts())}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state

    @cached_property
    def texts(self) -> dict[str, str]:
        return _rule_texts()

    @cached_property
    def guesses(self) -> list[tuple[re.Pattern, frozenset, bool]]:
        parts = [x.split() for _, x in _lines(self.texts["gen_lang"])]
        return [(re.compile(rx), frozenset(langs.split("+")), keep == "true") for rx, langs, keep in parts]

    @cached_property
    def known(self) -> frozenset:
        return frozenset(x for _, x in _lines(self.texts["gen_languages"]))

    @cached_property
    def tables(self) -> dict[str, dict[str, list[tuple]]]:
        return {}

    def rules(self, name: str) -> dict[str, list[tuple]]:
        """By first letter, in order: (pattern, what stands before, what stands after, phonemes)."""
        if name not in self.tables:
            table: dict[str, list[tuple]] = {}
            self._read(name, table)
            self.tables[name] = table
        return self.tables[name]

    def _read(self, name: str, table: dict[str, list[tuple]]) -> None:
        for _, line in _lines(self.texts[name]):
            if line.startswith("#include"):
                self._read(line.split()[1], table)
            else:
                pattern, before, after, phonemes = (x.strip('"') for x in line.split())
                table.setdefault(pattern[:1], []).append((pattern, _context(before + "$"), _context("^" + after), self._phonemes(phonemes)))

    @staticmethod
    def _phonemes(text: str) -> list[tuple[str, Languages]]:
        def one(x: str) -> tuple[str, Languages]:
            sound, _, langs = x.partition("[")
            return sound, frozenset(langs[:-1].split("+")) if langs else None

        if not text.startswith("("):
            return [one(text)]
        parts = text[1:-1].split("|")
        ends = [("", None)] if not parts[0] or not parts[-1] else []
        while parts and not parts[-1]:
            parts.pop()
        return [one(x) for x in parts] + ends

    def guessed(self, name: str) -> Languages:
        langs = self.known
        for rx, some, keep in self.guesses:
            if rx.search(name):
                langs = langs & some if keep else langs - some
        return langs or None

    @staticmethod
    def _applied(rules: dict[str, list[tuple]], text: str, i: int, built: list[tuple[str, Languages]]) -> tuple[int, list[tuple[str, Languages]] | None]:
        """Where to go on, and what was built so far with the first rule that fits (None without one)."""
        for pattern, before, after, phonemes in rules.get(text[i], ()):
            end = i + len(pattern)
            if text.startswith(pattern, i) and after(text[end:]) and before(text[:i]):
                out = []
                for sound, langs in built:
                    for more, also in phonemes:
                        left = _both(langs, also)
                        if left is None or left:
                            out.append((sound + more, left))
                            if len(out) >= MOST_PHONEMES:
                                return end, out
                return end, out
        return i + 1, None

    def _levelled(self, built: list[tuple[str, Languages]], rules: dict[str, list[tuple]]) -> list[tuple[str, Languages]]:
        if not rules:
            return built
        out: dict[str, Languages] = {}
        for text, langs in built:
            now: list[tuple[str, Languages]] = [("", langs)]
            i = 0
            while i < len(text):
                j, found = self._applied(rules, text, i, now)
                now = [(sound + text[i], x) for sound, x in now] if found is None else found
                i = j
            for sound, x in now:
                if sound in out:
                    a = out[sound]
                    out[sound] = x if a is None or x is None else a | x  # as that encoder merges them
                else:
                    out[sound] = x
        return sorted(out.items(), key=lambda x: x[0].encode("utf-16-be"))

    def __call__(self, name: str) -> str:
        langs = self.guessed(name.lower())
        text = name.lower().replace("-", " ").strip()
        for particle in _PARTICLES_IN_TURN:
            start = particle + ("" if particle == "d'" else " ")
            if text.startswith(start):
                rest = text[len(start) :]
                return f"({self(rest)})-({self(particle.rstrip(chr(39)) + rest)})"
        text = " ".join(text.split())
        table = next(iter(langs)) if langs is not None and len(langs) == 1 else "any"
        built: list[tuple[str, Languages]] = [("", langs)]
        i = 0
        while i < len(text):
            i, found = self._applied(self.rules(f"gen_rules_{table}"), text, i, built)
            built = built if found is None else found
        built = self._levelled(self._levelled(built, self.rules("gen_approx_common")), self.rules(f"gen_approx_{table}"))
        return "|".join(sound for sound, _ in built)


# A longer particle may begin with a shorter one; which is tried first decides.
_PARTICLES_IN_TURN = ("d'", *PARTICLES)


def encoded_by(encoder, name: str = "encoder") -> Transform:
    """Any Python encoder of strings as a transformation; its errors give NULL here and raise in the plain form."""

    def run(x: pd.Series) -> pd.Series:
        memo: dict = {}

        def one(s):
            if s not in memo:
                try:
                    memo[s] = None if s is None else encoder(s)
                except (ValueError, KeyError, IndexError):
                    memo[s] = None
            return memo[s]

        return x.map(one, na_action="ignore")

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    run.__name__ = name
    return Transform(lambda c: F.pandas_udf(run, T.StringType())(c), encoder)


def cologne_phonetic() -> Transform:
    return encoded_by(cologne, "cologne")


def beider_morse() -> Transform:
    """The full code, on executors; see ``BeiderMorse``."""
    return encoded_by(BeiderMorse(), "beider_morse")
