"""Text garbled by decoding bytes in another encoding than they were written in.

A multinomial classifier over hashed byte bigrams is trained on synthetically garbled words: the
most frequent words of all lines (and a few fixed phrases) are put through every encoding chain
under consideration, each chain being a class, the words as they are being the class of proper
text. A line is scored word by word; the stretch of words with the greatest log odds of a chain
against proper text is the suspected piece. The chain is then inverted; only if that decodes
strictly, the piece counts as garbled and is replaced by the original text; a stretch that does not
is split where decoding fails, and its parts are tried. Replacement characters prove a wrong decoding
too, but one that lost the original.

The wrong readings are single-byte encodings. Text read as GBK, Shift-JIS, Big5 or EUC-KR belongs to
no class; it is found only where a replacement character stands in it, and never restored.
"""

from __future__ import annotations

import bisect
import codecs
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Different words that the classifier is trained on at most, the most frequent of all lines, and their length.
SAMPLE_WORDS = 3_000
SAMPLE_LENGTH = 200
BUCKETS = 1 << 12
#: Log odds that a stretch of words must exceed.
LEAST_ODDS = 7.0
#: Share of a language's words that an encoding must be able to hold.
WRITABLE = 0.5
#: A word that a chain makes of one so many times more frequent is taken for garbled in training.
RARER = 4
LOST = "lost"

_WRITTEN = ("utf-8", "cp1252", "iso8859_15", "iso8859_2", "cp1250", "cp1251", "koi8_r", "iso8859_5", "cp866", "cp1253", "iso8859_7", "cp1254", "cp1257", "cp437", "cp850", "cp852", "mac_roman", "gb18030", "shift_jis", "euc_jp", "big5", "euc_kr")
#: Of these, the ones that have characters of several bytes, the last of which may be ASCII.
_WIDE = frozenset(("gb18030", "shift_jis", "euc_jp", "big5", "euc_kr"))
_READ = ("cp1252", "latin-1", "cp1250", "cp1251", "koi8_r", "cp437", "cp850", "mac_roman", "iso8859_2", "cp866", "cp1253", "cp1254")
_TWICE = (("utf-8", "cp1252", "utf-8", "cp1252"), ("utf-8", "latin-1", "utf-8", "latin-1"), ("utf-8", "cp1252", "utf-8", "latin-1"), ("utf-8", "latin-1", "utf-8", "cp1252"), ("utf-8", "cp1251", "utf-8", "cp1251"), ("utf-8", "cp1250", "utf-8", "cp1250"), ("utf-8", "cp1252", "utf-8", "cp1252", "utf-8", "cp1252"))
#: Every chain: written in the first, read in the second, and so on.
CHAINS = (*((w, r) for w in _WRITTEN for r in _READ if w != r), *_TWICE)

#: Proper text of many languages, so that the classifier knows their letters whatever the table holds.
PHRASES = (
    "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich; Jörg bäckt quasi zwei Haxenfüße vom Wildpony, heißölrückstoßabdämpfung; Fix, Schwyz! quäkt Jürgen blöd vom Paß; süße Nüsse, grüne Hügel, schöne Vögel, Möwen möchten, tiefe Höhle, völlig, Löffel, fördern, töpfern, König, zählen, Äxte, Öle, Übel",
    "Voix ambiguë d'un cœur qui au zéphyr préfère les jattes de kiwis; dès Noël où un zéphyr haï me vêt de glaçons würmiens, je dîne d'exquis rôtis de bœuf à l'aÿ d'âge mûr",
    "El pingüino Wenceslao hizo kilómetros bajo exhaustiva lluvia y frío, añoraba a su querido cachorro; ¡jovencillo emponzoñado de whisky, qué figurota exhibís! ¿sabíais?",
    "Luís argüia à Júlia que brações, fé, chá, óxido, pôr, zângão eram palavras; à noite vovô Kowalsky vê o ímã cair no pé do pinguim e lança a sertã, põe maçãs, razões",
    "Quel vituperabile xenofobo zelante assaggia il caffè ed esclama: l'aiuola, ahimè, lassù è laggiù, virtù, lunedì, falò",
    "Pchnąć w tę łódź jeża lub ośm skrzyń fig; zażółć gęślą jaźń, mężny bądź, chroń pułk twój i sześć flag",
    "Nechť již hříšné saxofony ďáblů rozezvučí síň úděsnými tóny waltzu, tanga a quickstepu; loď čeří kýlem tůň obzvlášť; dvakrát měř, jednou řež, tři přátelé přišli před večeří přes příkop, ať žijí růže a dům můj",
    "Jó foxim és don Quijote húszwattos lámpánál ülve egy pár bűvös cipőt készít; öt hűtőházból kértünk színhúst",
    "Pijamalı hasta yağız şoföre çabucak güvendi; fahiş bluz güvencesi yağdırma projesi çöktü, İğdır",
    "Muzicologă în bej vând whisky și tequila, preț fix; bând whisky, jazologul șprițuit vomă fix în tequila, ţuică, şapte",
    "Høvdingens kjære squaw får litt pizza i Mexico by; quizdeltagerne spiste jordbær med fløde, mens cirkusklovnen spillede på xylofon, Ærø",
    "Flygande bäckasiner söka hwila på mjuka tuvor; yxskaftbud, ge vår wc-zonmö iq-hjälp, törsten, ändå",
    "Kæmi ný öxi hér, ykist þjófum nú bæði víl og ádrepa; sævör grét áðan því úlpan var ónýt, Ýsa, Þór, Ðí",
    "В чащах юга жил бы цитрус? Да, но фальшивый экземпляр! Эх, чужак, общий съём цен шляп вдрызг; широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства",
    "Чуєш їх, доцю, га? Кумедна ж ти, прощайся без ґольфів! Жебракують філософи при ґанку церкви в Гадячі, ще й шатро їхнє п'яне",
    "Ξεσκεπάζω την ψυχοφθόρα σας βδελυγμία; γαζίες και μυρτιές δεν θα βρω πια στο χρυσαφί ξέφωτο, ταχίστη αλώπηξ, ώρα, ύψος",
    "天地玄黄 宇宙洪荒 日月盈昃 辰宿列张 寒来暑往 秋收冬藏 云腾致雨 露结为霜 金生丽水 玉出昆冈 剑号巨阙 珠称夜光",
    "いろはにほへと ちりぬるを わかよたれそ つねならむ うゐのおくやま けふこえて あさきゆめみし ゑひもせす トリナクコヱス ユメサマセ ミヨアケワタル 春の夜の夢",
    "키스의 고유조건은 입술끼리 만나야 하고 특별한 기술은 필요치 않다 다람쥐 헌 쳇바퀴에 타고파 참나무 타는 소리와 야경만큼",
    "“curly” ‘single’ „low“ «angle» – en — em … dots • bullet · middle €5 £7 ¥9 ±3° ½ × ¼ ÷ ≤ ≥ ≠ ∑ √ ∞ → ← ✓ § © ® ™ °F µs",
    "┌──┐ │ ├── └── ░▒▓ ═══ ║ █ ▄",
)

#: Words end at ASCII blanks and punctuation only: other blanks may be bytes read wrongly.
_TOKEN = re.compile(r"[^ \t\n\r\f\v\"'|;,(){}<>\[\]=:`]+")
_JAVA_TOKEN = _TOKEN.pattern.replace("\\v", "\\x0B")
_UNDEFINED = re.compile("[\x80-\x9f]")


@lru_cache(maxsize=None)
def _reader(encoding: str) -> tuple[list[str], dict[str, int]]:
    """The character of each byte and back; undefined bytes are read as control characters."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(b))
    back: dict[str, int] = {}
    for b, c in enumerate(chars):
        back.setdefault(c, b)
    return chars, back


@lru_cache(maxsize=None)
def _table(encoding: str) -> str:
    return "".join(_reader(encoding)[0])


def _written(text: str, encoding: str) -> bytes | None:
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        return None


def garble(text: str, chain: tuple[str, ...]) -> str | None:
    """What the chain makes of proper text; null where the text can't be written so."""
    for written, read in zip(chain[::2], chain[1::2]):
        data = _written(text, written)
        if data is None:
            return None
        text = codecs.charmap_decode(data, "strict", _table(read))[0]
    return text


def restore(text: str, chain: tuple[str, ...]) -> str | None:
    """Inverts the chain; null unless every step can be inverted and decodes strictly."""
    for written, read in zip(chain[-2::-2], chain[::-2]):
        back = _reader(read)[1]
        try:
            text = bytes([back[c] for c in text]).decode(written)
        except (KeyError, UnicodeDecodeError):
            return None
    return text


def _fails(text: str, chain: tuple[str, ...]) -> int:
    """Where in a text inverting the chain fails, or gives a control character; its length if nowhere."""
    written, read = chain[-2:]
    back = _reader(read)[1]
    stop = next((i for i, c in enumerate(text) if c not in back), len(text))
    data = bytes([back[c] for c in text[:stop]])
    try:
        within = data.decode(written)
    except UnicodeDecodeError as e:
        stop = e.start
        within = data[:stop].decode(written)
    if len(chain) > 2:
        at = _fails(within, chain[:-2])
    else:
        m = _UNDEFINED.search(within)
        at = m.start() if m else len(within)
    return stop if at >= len(within) else len(within[:at].encode(written))


def _bigrams(token: str) -> np.ndarray:
    b = np.frombuffer(b" " + token.encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    return ((b[:-1] << 8 | b[1:]) * np.uint32(2654435761)) >> np.uint32(20)


class Classifier:
    """Log odds of each chain and language against proper text of any language.

    Proper words are dealt to the languages of ``PHRASES`` by the bigrams of the phrases, then by
    those of the words dealt out first. Each language is a class of proper text and, garbled by a
    chain, a class of that chain, so that only texts of like variety are compared.
    """

    def __init__(self, frequent: dict[str, int]):
        words = dict(frequent)
        typical = max(1, sum(words.values()) // 20_000)
        home: dict[str, int] = {}
        for k, phrase in enumerate(PHRASES):
            for t in _TOKEN.findall(phrase):
                if not t.isascii():
                    words[t] = words.get(t, 0) + typical
                    home.setdefault(t, k)
        tokens = list(words)
        weight = np.array([words[t] for t in tokens], float)
        for i, t in enumerate(tokens):  # words that some reading of UTF-8 explains are not proper text
            if t not in home and any(self._explained(t, r) for r in _READ):
                weight[i] = 0
        place = {t: i for i, t in enumerate(tokens)}
        chained: dict[tuple[str, ...], list[tuple[int, str]]] = {c: [] for c in CHAINS}
        bytes_in = {e: [_written(t, e) for t in tokens] for e in dict.fromkeys(c[0] for c in CHAINS)}
        for chain, made in chained.items():
            table, rest = _table(chain[1]), chain[2:]
            for i, data in enumerate(bytes_in[chain[0]]):
                g = None if data is None else codecs.charmap_decode(data, "strict", table)[0]
                g = garble(g, rest) if g and rest else g
                if g and g != tokens[i] and not g.isascii():
                    made.append((i, g))
        for made in chained.values():  # nor are words that a chain makes of far more frequent ones
            for i, g in made:
                j = place.get(g)
                if j is not None and g not in home and words[g] * RARER < words[tokens[i]]:
                    weight[j] = 0
        own = [_bigrams(t) for t in tokens]
        size = np.array([len(x) for x in own])
        owner, bucket = np.repeat(np.arange(len(tokens)), size), np.concatenate(own)
        language = np.array([home.get(t, -1) for t in tokens])
        for _ in range(3):
            known = self._tables(owner, bucket, weight, language, len(PHRASES))
            fit = np.stack([np.add.reduceat(row[bucket], np.cumsum(size) - size) for row in known])
            language = np.array([home.get(t, best) for t, best in zip(tokens, fit.argmax(0).tolist())])
        self.classes: list[tuple[tuple[str, ...], int]] = []
        made_by: list[tuple[np.ndarray, np.ndarray]] = []
        known_as: set[tuple[int, int]] = set()
        spoken = np.bincount(language, weights=weight, minlength=len(PHRASES))
        for chain in CHAINS:
            made: dict[int, list[tuple[int, str]]] = {}
            for i, g in chained[chain]:
                if weight[i]:
                    made.setdefault(int(language[i]), []).append((i, g))
            for k, pairs in made.items():
                same = (k, hash(tuple(pairs)))
                if weight[[i for i, _ in pairs]].sum() < WRITABLE * spoken[k]:
                    continue  # nobody writes a language in an encoding that can't hold most of its words
                if len(pairs) >= 3 and same not in known_as:  # chains that make the same of a language are one class
                    known_as.add(same)
                    parts = [_bigrams(g) for _, g in pairs]
                    self.classes.append((chain, k))
                    made_by.append((np.repeat(np.array([i for i, _ in pairs], np.int32), [len(x) for x in parts]), np.concatenate(parts).astype(np.int32)))
        self.chains = [c for c, _ in self.classes]
        self._cache: dict[str, np.ndarray] = {}
        for _ in range(2):  # again without the words that the first classifier finds garbled
            self.proper = np.ascontiguousarray(self._tables(owner, bucket, weight, language, len(PHRASES)).T)
            self.garbled = np.ascontiguousarray(np.stack([self._log(b, weight[o]) for o, b in made_by]).T)
            self._cache.clear()
            for i, t in enumerate(tokens):
                if weight[i] and t not in home and self._suspect(t):
                    weight[i] *= 0.01
        self._cache.clear()

    def __getstate__(self) -> dict:
        """Half precision is enough to travel with."""
        return self.__dict__ | {"garbled": self.garbled.astype(np.float16), "_cache": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"garbled": state["garbled"].astype(np.float32)})

    @staticmethod
    def _explained(token: str, read: str) -> bool:
        found = restore(token, ("utf-8", read))
        return found is not None and len(found) < len(token)

    @staticmethod
    def _log(bucket: np.ndarray, weight: np.ndarray) -> np.ndarray:
        n = np.bincount(bucket, weights=weight, minlength=BUCKETS)
        share = n / max(n.sum(), 1e-9)
        return np.log((share * 1e4 + 0.05) / (1e4 + 0.05 * BUCKETS)).astype(np.float32)

    @classmethod
    def _tables(cls, owner: np.ndarray, bucket: np.ndarray, weight: np.ndarray, language: np.ndarray, n: int) -> np.ndarray:
        of = language[owner]
        return np.stack([cls._log(bucket[of == k], weight[owner[of == k]]) for k in range(n)])

    def _suspect(self, token: str) -> bool:
        s = self.score(token)
        k = int(s.argmax())
        return s[k] > LEAST_ODDS and restore(token, self.chains[k]) is not None

    def score(self, token: str) -> np.ndarray:
        """Log odds of each class against the most likely language of proper text."""
        s = self._cache.get(token)
        if s is None:
            if len(self._cache) > 20_000:
                self._cache.clear()
            b = _bigrams(token)
            s = self._cache[token] = self.garbled[b].sum(0) - self.proper[b].sum(0).max()
        return s

    def _next(self, line: str, at: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray] | None:
        """The next words from an offset that hold a suspect stretch, and that no class's stretch leaves.

        With each class's greatest log odds of a stretch, its first and its last word.
        """
        tokens: list[tuple[int, int]] = []
        k = len(self.chains)
        for m in _TOKEN.finditer(line, at):
            word = m.group()
            if word.isascii() or "\ufffd" in word:
                continue
            s = self.score(word)
            if not tokens:
                if s.max() <= 0:
                    continue
                seen: set[str] = set()
                best, start, end = np.full(k, -np.inf, np.float32), np.zeros(k, np.int32), np.zeros(k, np.int32)
                run, begun = np.zeros(k, np.float32), np.zeros(k, np.int32)
            if word in seen:  # said before, it is no further evidence
                s = np.minimum(s, 0)
            seen.add(word)
            i = len(tokens)
            tokens.append(m.span())
            fresh = run <= 0
            begun = np.where(fresh, i, begun)
            run = np.where(fresh, 0, run) + s
            better = run > best
            best, start, end = np.where(better, run, best), np.where(better, begun, start), np.where(better, i, end)
            if run.max() <= 0:
                if best.max() > LEAST_ODDS:
                    return tokens, best, start, end
                tokens = []
        return (tokens, best, start, end) if tokens and best.max() > LEAST_ODDS else None

    @staticmethod
    def _parts(line: str, tokens: list[tuple[int, int]], low: int, high: int, chain: tuple[str, ...], known: dict[str, bool]) -> list[tuple[int, int]]:
        """The runs of words from low to high that lie between words where inverting the chain fails."""
        out, i = [], low
        if chain[0] not in _WIDE:  # no character lasts from one word to the next
            for w in range(low, high):
                word = line[slice(*tokens[w])]
                if word not in known:
                    known[word] = _fails(word, chain) == len(word)
                if not known[word]:
                    out.append((i, w))
                    i = w + 1
            out.append((i, high))
        while chain[0] in _WIDE and i < high:
            step, a = 8, tokens[i][0]
            while (place := a + _fails(line[a : tokens[(j := min(i + step, high)) - 1][1]], chain)) >= tokens[j - 1][0] and j < high:
                step *= 2
            w = next((w for w in range(i, j) if tokens[w][1] > place), j)
            out.append((i, w))
            i = max(w, i + 1)
        return [(i, j) for i, j in out if i < j]

    def pieces(self, line: str, tokens: list[tuple[int, int]], best: np.ndarray, start: np.ndarray, end: np.ndarray, past: set[tuple[int, str]]) -> list[tuple[float, int, int, tuple[str, ...], str]]:
        """(log odds, start, end, chain, original) of pieces of the words that can be inverted, most suspect first.

        They do not overlap; none is less suspect than one that overlaps them. A stretch that can't be
        inverted is split at the words where its chain fails, and its parts are searched. ``past`` holds
        the characters that places of the line had; a piece must not just bring them back.
        """
        n = len(tokens)
        above = np.flatnonzero(best > LEAST_ODDS)
        above = above[np.argsort(-best[above], kind="stable")]
        # in order, which is a heap
        heap = list(zip((-best[above]).tolist(), range(len(above)), above.tolist(), [0] * len(above), [n] * len(above), start[above].tolist(), end[above].tolist()))
        again, seen = [], set()
        for i, j in tokens:
            again.append(line[i:j] in seen)
            seen.add(line[i:j])
        own_score = lambda w: np.minimum(self.score(line[slice(*tokens[w])]), 0) if again[w] else self.score(line[slice(*tokens[w])])
        scores = np.stack([own_score(w) for w in range(n)]).T if n <= 4096 else None
        # words that are proper in any class make no stretch by themselves
        waiting = {i for i, k in enumerate((scores.max(0) > 0).tolist()) if k} if scores is not None else {-1}
        odds_of: dict[int, list[float]] = {}
        known: dict[tuple[str, ...], dict[str, bool]] = {}
        hits: list[tuple[float, int, int, tuple[str, ...], str]] = []
        spans: list[tuple[int, int]] = []
        taken = bytearray(n)
        while heap and waiting:
            odds, k, c, low, high, first, last = heapq.heappop(heap)
            a, b = tokens[first][0], tokens[last][1]
            chain = self.chains[c]
            parts = [(low, first), (last + 1, high)]
            if taken.find(0, first, last + 1) >= 0:
                for x, y in ((a, b), (a, b + 1), (a - 1, b), (a, b - 1)):
                    if 0 <= x < y <= len(line):
                        original = restore(line[x:y], chain)
                        if original is not None and original != line[x:y] and not _UNDEFINED.search(original) and _onward(line, x, y, original, past) and (chain[0] not in _WIDE or _of_one_script(original)):
                            break
                else:
                    original = None
                    if a + _fails(line[a:b], chain) < b:  # else it can be inverted, but that changes nothing or brings back what was there
                        parts.append((first, last + 1))
                if original is not None:
                    at = bisect.bisect(spans, (x, y))
                    if at and spans[at - 1][1] > x or at < len(spans) and spans[at][0] < y:
                        break
                    spans.insert(at, (x, y))
                    taken[first : last + 1] = b"\1" * (last + 1 - first)
                    waiting.difference_update(range(first, last + 1))
                    hits.append((-odds, x, y, chain, original))
            if c not in odds_of:
                odds_of[c] = (scores[c] if scores is not None else np.array([own_score(w)[c] for w in range(n)])).tolist()
            own = odds_of[c]
            for i, j in (p for part in parts if part[0] < part[1] for p in self._parts(line, tokens, *part, chain, known.setdefault(chain, {}))):
                most, run = LEAST_ODDS, 0.0
                found = None
                for w in range(i, j):
                    if run <= 0:
                        run, begun = 0.0, w
                    run += own[w]
                    if run > most:
                        most, found = run, (begun, w)
                if found is not None and found != (first, last):
                    heapq.heappush(heap, (-most, k, c, i, j, *found))
        return hits

    def repair(self, line: str) -> tuple[list[str], str]:
        """The chains found in a line, most suspect first, and the line with their pieces restored."""
        found: list[list[tuple[float, str]]] = [[]]
        past: set[tuple[int, str]] = set()
        at = 0
        while (part := self._next(line, at)) is not None:
            tokens = part[0]
            hits = self.pieces(line, *part, past)
            if not hits:
                at = tokens[-1][1]
                found.append([])
                continue
            found[-1] += [(odds, ">".join(chain)) for odds, _, _, chain, _ in hits]
            if any(len(original) < y - x for _, x, y, _, original in hits):
                past.clear()
            else:
                for _, x, y, _, original in hits:
                    past.update(enumerate(line[x:y], x), enumerate(original, x))
            done, out = 0, []
            for _, x, y, _, original in sorted(hits, key=lambda h: h[1]):
                out += [line[done:x], original]
                done = y
            line = "".join([*out, line[done:]])
            at = min(tokens[0][0], *(x for _, x, _, _, _ in hits))
            while at and _TOKEN.match(line[at - 1]):
                at -= 1
        chains = [name for _, name in heapq.merge(*found, key=lambda f: -f[0])]
        if "\ufffd" in line:
            chains.append(LOST)
        return chains, line

    def suspect(self, line: str) -> bool:
        """Whether a stretch of the line is more likely garbled than proper text."""
        return self._next(line, 0) is not None


def _of_one_script(text: str) -> bool:
    """Whether text of an encoding with wide characters has more of these than of Latin letters."""
    return 2 * sum(c > "\u2e7f" for c in text) > sum(c.isalpha() for c in text)


def _onward(line: str, x: int, y: int, original: str, past: set[tuple[int, str]]) -> bool:
    """Whether the original is shorter or has a character that its place never had, so that repair ends."""
    return len(original) < y - x or len(original) == y - x and any(new != old and (k, new) not in past for k, (old, new) in enumerate(zip(line[x:y], original), x))


def training_words(df: DataFrame, text: str, limit: int = SAMPLE_WORDS) -> dict[str, int]:
    """The ``limit`` most frequent words with other than ASCII characters, and how often all lines hold them.

    Lines with replacement characters do not count, nor do words of more than ``SAMPLE_LENGTH`` characters.
    """
    word = F.explode(F.regexp_extract_all(F.col(text), F.lit(_JAVA_TOKEN), F.lit(0))).alias("word")
    rows = df.where(F.col(text).rlike(r"[^\x00-\x7f]") & ~F.contains(F.col(text), F.lit("\ufffd"))).select(word)
    counts = rows.where(F.col("word").rlike(r"[^\x00-\x7f]") & (F.length("word") <= SAMPLE_LENGTH)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r["word"]: r["n"] for r in counts.orderBy(F.desc("n"), "word").limit(limit).collect()}


def find_garbled(df: DataFrame, key: str, text: str, limit: int = SAMPLE_WORDS) -> DataFrame:
    """(key, chains, restored, is_restored) of every row whose text is garbled, wholly or in part.

    ``chains`` names the encodings passed through, innermost last; ``lost`` stands for replacement
    characters, whose original is gone. ``restored`` is the text with every piece that could be
    inverted put right, however many there are; ``is_restored`` whether that is all of it, that is,
    nothing is lost and nothing suspect is left.

    Cases: null, empty and ASCII texts are proper; repeated rows give repeated rows; texts may be of
    any length, all words being scored; an empty table gives an empty result; other columns are not
    read. The classifier is trained on the ``limit`` most frequent words, counted over all rows; all
    rows are judged.
    """
    # a few MB: BUCKETS half-precision numbers for each of the bounded number of classes
    shared = df.sparkSession.sparkContext.broadcast(Classifier(training_words(df, text, limit)))
    rows = df.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out = []
            for k, line in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                chains, better = model.repair(line)
                if chains:
                    out.append((k, chains, better, LOST not in chains and not model.suspect(better)))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("key").type), pa.array(cols[1], pa.list_(pa.string())), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())], names=["key", "chains", "restored", "is_restored"])

    return rows.mapInArrow(run, T.StructType([T.StructField("key", kind), T.StructField("chains", T.ArrayType(T.StringType())), T.StructField("restored", T.StringType()), T.StructField("is_restored", T.BooleanType())]))
