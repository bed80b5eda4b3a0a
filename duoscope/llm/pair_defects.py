"""Broken prompt and response pairs (problem 5).

A multi-label linear classifier (one logistic regression per defect) over
hashed word n-grams, the surroundings of a value's first and last words, and
features of the pair: how much of the reply stands in its prompt, how much of
it is English, whether its last word is broken.  It is trained on synthetic
defects made from a bounded sample of replies: cut, copied and swapped ones,
placeholders, refusals from a small grammar, and foreign texts strung together
from frequent words of their languages.  Refusals the grammar doesn't know are
learned from replies whose extracted answer is ``refused`` and from those that
a first model is sure of.  Thresholds are calibrated on held-out rows.  Which
words are English, and which begin more frequent ones, is counted over all rows.
Inference reads each row once, in whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.llm.tokens import SHARE, Words, bounded, count_words, mix
from duoscope.llm.truncation import _is_answer, _is_closed
from duoscope.runtime import materialize

#: Rows of the training sample (a bound on training only), hash buckets, passes.
TRAIN_ROWS, BUCKETS, EPOCHS = 4_000, 1 << 17, 6
LABELS = ["empty", "language", "copy", "refusal", "truncated"]

# What stands where an answer should, and beginnings of technical notices.
PLACEHOLDERS = ["", " ", "  ", "\n", "\n\n", "\t", " ", "​", "-", "--", "...", "…", ".", "?", "n/a", "N/A", "na", "none", "None", "NONE", "null", "NULL", "nil", "nan", "NaN", "undefined", "empty", "<empty>", "[empty]", "(empty)", "<none>", "[none]", "[no response]", "(no response)", "no response", "(no output)", "[no output]", "no output", "no answer", "[no answer]", "[blank]", "<blank>", "tbd", "TODO", "[deleted]", "[removed]", "[missing]", "{}", "[]", "()", '""', "<pad>", "<eos>", "</s>", "<|endoftext|>"]
NOTICES = ["Error: connection reset by backend", "[error: upstream timed out]", "Error: request timed out", "Error 500: internal server error", "HTTP 503 Service Unavailable", "502 Bad Gateway", "ReadTimeout: timed out after 60 s", "[error: rate limit exceeded]", "Traceback (most recent call last):", "connection refused", "Error code: 429", "[system: model overloaded]", "ValueError: empty completion", "Exception: worker died", "[timeout]", "<error>", "upstream connect error", "Warning: response withheld by gateway", "context length exceeded", "Error: out of memory"]
# Refusals: each line is a pattern of slots; a slot is one of the words of its name below, or itself.
REFUSALS = """
SORRY I NOT DO THAT TAIL
I NOT DO THAT TAIL
SORRY THAT IS AGAINST RULES TAIL
THAT IS AGAINST RULES TAIL
SORRY THAT IS SOMETHING I NOT DO TAIL
ANSWERING THAT WOULD BREAK RULES TAIL
I WAS MADE TO AVOID THAT TAIL
THERE IS NO ANSWER FROM ME TAIL
PLEASE ASK ELSE TAIL
SORRY WE CHANGE TAIL
WE CHANGE TAIL
I DECLINE TAIL
SORRY I DECLINE TAIL
SORRY
NO
NO I NOT DO THAT
"""
SLOTS = {
    "SORRY": "sorry, but|I regret that|unfortunately|I apologise, but|apologies, but|regrettably,|I am sorry:|sadly,|no,|as a machine,|as an assistant,|being a program,|to be clear,|honestly,",
    "I": "I|we|this assistant",
    "NOT": "can't|cannot|can not|couldn't|won't|will not|wouldn't|am unable to|am not able to|am not willing to|am not going to|do not want to|don't wish to|refuse to|decline to|must decline to|have to decline to|am not allowed to|am not permitted to|would rather not|'d rather not|prefer not to|should not|choose not to|ain't going to|am not here to|am not comfortable to",
    "DO": "help|assist|answer|respond to|reply to|continue|write|say|discuss|comment on|provide|join in|take part in|produce|complete|engage in|talk about|speak about|touch|do|go on with|go into|support|share|describe|repeat",
    "THAT": "this|that|it|such a thing|requests of this sort|the request|this question|questions like these|such content|content like this|that subject|these subjects|your message|anything of the kind|the matter|such matters",
    "IS": "is|would be|goes|falls|lies|remains",
    "AGAINST": "against|outside|beyond|in conflict with|contrary to|not within",
    "RULES": "the rules|my rules|policy|my policy|the guidelines|my limits|my values|my training|what I am for|what I may do|the bounds set for me",
    "SOMETHING": "something|a thing|a subject|a request|one",
    "ANSWERING": "answering|writing|doing|continuing|discussing|responding to|saying",
    "WOULD": "would|may|might|could",
    "BREAK": "break|violate|breach|go against|offend against",
    "WAS": "was|am|have been",
    "MADE": "made|built|designed|trained|told|instructed|programmed",
    "TO": "to",
    "AVOID": "avoid|refuse|stay out of|keep away from|leave alone|decline",
    "THERE": "there|here there",
    "NO": "no|nope|never|not a chance",
    "ANSWER": "answer|reply|response|comment|help",
    "FROM": "from|by",
    "ME": "me|my side|us",
    "PLEASE": "please|you should|you could|better",
    "ASK": "ask|try|consult|turn to|look for",
    "ELSE": "somebody else|another person|a person trained for it|an expert|other sources|another question",
    "WE": "let us|shall we|may we|could we perhaps|why don't we",
    "CHANGE": "change the topic|speak of other things|move on|leave it there|drop this|pick a different question",
    "DECLINE": "decline|refuse|pass|abstain|object|say no",
    "TAIL": "||||at all|here|today|for anyone|in any form|as it stands",
}
# Frequent words of other languages, articles, pronouns, verbs, numerals and the like; texts are strung together from them.
FOREIGN = """
der die das und ist nicht ein eine zu den mit auf für von im dem auch wir ich es sie haben hat werden wird noch nur aber wenn dann also antwort frage richtig zahl eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig hundert
le la les un une des et est pas que qui dans pour sur avec nous vous il elle ils ce cette donc mais plus très aussi avons sont fait réponse question nombre juste deux trois quatre cinq six sept huit neuf dix onze douze vingt trente quarante cent
el la los las un una y es no que en por para con se lo su al del más pero como entonces también tenemos son hay está respuesta pregunta número correcta dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cuarenta cien
o a os as um uma e é não que em por para com se do da no na mais mas como então também temos são há está resposta pergunta número certa dois três quatro cinco seis sete oito nove dez onze doze vinte trinta quarenta cem
il lo la i gli le un una e è non che in per con si del della nel più ma come allora anche abbiamo sono c'è risposta domanda numero giusta due tre quattro cinque sei sette otto nove dieci undici dodici venti trenta quaranta cento
de het een en is niet dat in op te van met voor zijn er wij ik ze heeft hebben worden ook maar dan dus nog antwoord vraag juist getal twee drie vier vijf zes zeven acht negen tien elf twaalf twintig dertig veertig honderd
nie to jest w na z do się że i o jak ale tak po co za od ma są być dla już tylko więc także mamy odpowiedź pytanie liczba dwa trzy cztery pięć sześć siedem osiem dziewięć dziesięć jedenaście dwanaście dwadzieścia trzydzieści sto
och det att i en som är på av för med den till inte om ett men vi jag har kan så också då finns svar fråga tal rätt två tre fyra fem sex sju åtta nio tio elva tolv tjugo trettio fyrtio hundra
og det at en som er på av for med den til ikke om et men vi jeg har kan så også da svar spørsmål tall riktig to tre fire fem seks syv åtte ni ti elleve tolv tjue tretti hundre
ja se on ei että hän mutta niin kuin tämä ovat minä me myös sitten vastaus kysymys oikea luku kaksi kolme neljä viisi kuusi seitsemän kahdeksan yhdeksän kymmenen sata
a az és nem hogy egy van ez de is csak meg már mint azt lesz akkor tehát válasz kérdés helyes szám kettő három négy öt hat hét nyolc kilenc tíz húsz harminc száz
a je se na v že to s z do o jako ale tak už jsou být má také pak odpověď otázka správná číslo dva tři čtyři pět šest sedm osm devět deset dvacet třicet sto
ve bir bu da de için ile çok daha ama gibi var yok olan sonra biz ben o değil cevap soru doğru sayı iki üç dört beş altı yedi sekiz dokuz on yirmi otuz yüz
dan yang di itu ini dengan untuk tidak dari dalam akan pada juga ke adalah kami saya jadi jawaban pertanyaan benar angka dua tiga empat lima enam tujuh delapan sembilan sepuluh seratus
hai ka ki ke mein se aur ko nahin yah vah ek par bhi to hum main kya phir kul uttar sawal sahi do teen char paanch chhah saat aath nau das bees tees sau
agus an na i ar tá níl sé sí le go do bhí ach mar seo sin mé muid freagra ceist ceart uimhir dó trí ceathair cúig sé seacht ocht naoi deich fiche céad
и в не на что с по это как но из у же за от мы я он она они так также затем всего ответ вопрос верно число два три четыре пять шесть семь восемь девять десять двадцать тридцать сто
і в не на що з по це як але у за від ми я він вона вони так також потім всього відповідь питання число два три чотири п'ять шість сім вісім дев'ять десять двадцять сто
και το η ο να δεν με για από στο είναι που ένα μια αλλά εμείς εγώ επίσης τότε απάντηση ερώτηση σωστή αριθμός δύο τρία τέσσερα πέντε έξι επτά οκτώ εννέα δέκα εκατό
और है का की के में से को नहीं यह वह एक पर भी तो हम मैं क्या फिर कुल उत्तर सवाल सही दो तीन चार पांच छह सात आठ नौ दस बीस तीस सौ
এবং না এই একটি যে করে হয় আমরা আমি তারা তারপর উত্তর প্রশ্ন সঠিক সংখ্যা দুই তিন চার পাঁচ ছয় সাত আট নয় দশ
و في من على أن لا هذا هذه إلى مع كان هو هي نحن أنا ثم أيضا الجواب السؤال صحيح رقم اثنان ثلاثة أربعة خمسة ستة سبعة ثمانية تسعة عشرة مئة
של את על לא זה היא הוא עם כל אני אנחנו גם אבל אז תשובה שאלה נכון מספר שתיים שלוש ארבע חמש שש שבע שמונה תשע עשר
的 是 不 了 在 有 我 我们 这 那 和 也 就 所以 因为 答案 问题 正确 数字 二 三 四 五 六 七 八 九 十 百
の は に を が と で も です ます これ それ 私 私たち そして だから 答え 質問 正しい 数字 二 三 四 五 六 七 八 九 十 百
은 는 이 가 을 를 의 에 와 그리고 그래서 우리 나는 답 질문 맞는 숫자 둘 셋 넷 다섯 여섯 일곱 여덟 아홉 열 백
"""
# Frequent English words and numerals, so that short answers are known to be English.
ENGLISH = "a an the and or but if so then than as of at by for with about into through during before after above below to from up down in out on off over under again once here there when where why how all any both each few more most other some such no nor not only own same too very can will just should now is are was were be been being have has had do does did i you he she it we they me him her us them my your his its our their this that these those what which who whom yes true false maybe complied refused answer option choice total result zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand left none because first let think could would must may might".split()

_NOTICE = re.compile(r"\s*[\[(<{]?\s*(?:error|exception|traceback|timeout|warning|http|readtimeout|valueerror|runtimeerror|upstream|connection|system:)\b.{0,160}", re.I | re.S)
_BLANK = re.compile(r"[\s\W_]*(?:n/?a|none|null|nil|nan|undefined|empty|blank|missing|tbd|todo|(?:no|empty) (?:output|response|answer|data|content|text|reply))?[\s\W_]*", re.I)
_OPTION = re.compile(r"\s*\(?[A-D][).:]\s+\S")
_CLOSED = re.compile(r"[.?!।。][\"'”’)\]*»]*\s*\Z")
_DOTS = ("..", "…", "[...]", "[…]")
_BLANKS = " \t\n\r\u2028\u2029\u00a0\u2003\u3000\u200b\ufeff"
_RIGHT = _BLANKS + "\ufffd…[].,;:*-–—\"'”’("
_ANSWER = re.compile(r"(?:(?:\A\s*|\n\s*|:\s*|####\s*|=\s*|\b(?:answer|option|choice|total)\b(?:\s+(?:is|=))?\s*:?\s*|\*)\(?(?:[A-D]|[-+$]?\d[\d.,]*%?)\)?|[.!?…।]\s+\(?(?:[B-Db-d]|[-+$]?\d[\d.,]*%?)\)?)[.*\s]*\Z", re.I)
_LATIN = re.compile(r"[a-zà-ɏ]", re.I)


def _tag(name: str) -> int:
    return xxhash.xxh64_intdigest(name) & 0xFFFFFFFFFFFFFFFF


def _table(words: list[str], n: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, sorted, with their numbers."""
    h = Words(words)
    one = np.bincount(h.doc, minlength=len(words)) == 1
    keep = one[h.doc]
    at, order = h.doc[keep], np.argsort(h.exact[keep], kind="stable")
    return h.exact[keep][order], np.asarray(n, np.int64)[at][order]


def _find(keys: np.ndarray, hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return np.where(hashes[at] == keys, numbers[at], 0)


class Vocabulary:
    """Words of all prompts and replies: which are English, how often they stand, which begin more frequent ones."""

    def __init__(self, words: list[str], counts: list[int], english: list[bool]):
        known = {w for w, e in zip(words, english) if e} | set(ENGLISH)
        known |= {w for t in SLOTS.values() for w in re.findall(r"[^\W_]+(?:['\-][^\W_]+)*", t.lower())}
        starts: dict[str, int] = {}
        for w, n in zip(words, counts):
            for i in range(1, len(w)):
                if w[i - 1].isalnum() and starts.get(w[:i], 0) < n:
                    starts[w[:i]] = n
        self.known = np.sort(np.unique(Words(sorted(known)).exact))
        self.counts = _table(list(words), list(counts))
        self.starts = _table(list(starts), list(starts.values()))

    def is_known(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return self.known[at] == h

    def broken(self, h: np.ndarray) -> np.ndarray:
        """Whether last words are beginnings of much more frequent ones."""
        return _find(h, *self.starts) >= 10 * (_find(h, *self.counts) + 1)


def vocabulary(audits: DataFrame, share: float = SHARE) -> Vocabulary:
    """Counts the words of every prompt and reply; listed are those with at least ``share`` of all occurrences, so at most 1 / share words, and at least two."""
    texts = audits.select("original_prompt", "transformed_prompt", "original_response", "transformed_response")
    counts = materialize(texts.mapInPandas(count_words, "word string, n bigint, n_prompt bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_prompt").alias("n_prompt")))
    total, prompts = counts.agg(F.sum("n"), F.sum("n_prompt")).first()
    least, in_prompts = max(2, int(share * (total or 0))), max(2, int(share * (prompts or 0)))
    rows = counts.where((F.col("n") >= least) | (F.col("n_prompt") >= in_prompts)).orderBy("word").collect()
    return Vocabulary([r["word"] for r in rows], [r["n"] for r in rows], [r["n_prompt"] >= in_prompts for r in rows])


class Features:
    """Hashed features of values with their prompts, as flat arrays (bucket, value, row)."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def _english(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """English words and words of each text; a compound counts as English if a part does."""
        i = np.flatnonzero(~w.digit & (w.length > 1))
        known = self.v.is_known(w.exact[i])
        for k in np.flatnonzero(~known & w.joined[i]).tolist():
            parts = [p for p in re.split(r"['\-]", w.word(int(i[k]))) if len(p) > 1]
            known[k] = bool(parts) and bool(self.v.is_known(Words(parts).exact).any())
        return np.bincount(w.doc[i][known], minlength=w.n), np.bincount(w.doc[i], minlength=w.n)

    @staticmethod
    def copied(w: Words, prompts: Words) -> np.ndarray:
        """How much of each text stands in its prompt: 0 to 10, by word pairs."""

        def pairs(x: Words) -> tuple[np.ndarray, np.ndarray]:
            same = x.doc[1:] == x.doc[:-1]
            return mix(mix(x.exact[:-1], x.exact[1:]), x.doc[:-1].astype(np.uint64))[same], x.doc[:-1][same]

        (a, doc), (b, _) = pairs(w), pairs(prompts)
        n = np.bincount(doc, minlength=w.n)
        return 10 * np.bincount(doc[np.isin(a, b)], minlength=w.n) // np.maximum(1, n)

    def rows(self, texts: list[str | None], prompts: list[str | None], field: str, errors: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat features of a batch, sorted by row."""
        stripped = [t.rstrip(_RIGHT) if t else "" for t in texts]
        w = Words(stripped)
        bucket = lambda h, name: (mix(np.asarray(h).astype(np.uint64), np.uint64(_tag(name))) % np.uint64(BUCKETS)).astype(np.int64)
        index, value, row = [], [], []
        every = np.arange(len(texts))

        def add(i: np.ndarray, r: np.ndarray, v: np.ndarray | float = 1.0) -> None:
            index.append(i)
            row.append(r)
            value.append(np.broadcast_to(np.asarray(v, dtype=np.float32), i.shape))

        some = np.nonzero(w.counts)[0]
        last = w.starts[some] + w.counts[some] - 1
        broken = np.zeros(len(texts), bool)
        if len(w.ids):
            weight = (1.0 / np.sqrt(np.maximum(w.counts, 1)))[w.doc]
            add(bucket(w.masked, "1"), w.doc, weight)
            c = w.contexts()
            add(bucket(c["c2"], "2"), w.doc, weight)
            add(bucket(c["c3"], "3"), w.doc, weight)
            first = w.starts[some]
            for name in ("c1", "c2", "c3", "c4", "s1", "s2"):
                add(bucket(c[name][last], "end" + name), some)
            for k in range(3):
                ok = w.counts[some] > k
                at = first[ok] + k
                add(bucket(c[("c1", "c2", "c3")[k]][at], f"start{k}"), some[ok])
            broken[some] = w.at_end[last] & ~w.digit[last] & self.v.broken(w.exact[last])
        add(np.full(len(texts), _tag("field=answer" if field.endswith("answer") else "field=response") % BUCKETS), every)
        null = np.array([t is None for t in texts], bool)
        blank, notice, whole, shape, option = null.copy(), np.zeros(len(texts), bool), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t is None:
                continue
            bare = t.strip(_BLANKS)
            if len(bare) <= 48:
                whole[i] = 1 + zlib.crc32(bare.lower().encode("utf-8", "replace"))
                if _BLANK.fullmatch(bare):
                    blank[i] = True
                    continue
            notice[i] = _NOTICE.fullmatch(bare) is not None
            closed = _is_closed(bare) or bare.endswith("。")
            shape[i] = 1 if _is_answer(bare) else 2 if bare.endswith(_DOTS) else 3 if closed else 4 if bare.endswith("\ufffd") else 5 if bare.endswith(",") else 6
            if _OPTION.match(t):
                body = bare.rstrip(".*")
                at = prompts[i].find(body) if prompts[i] else -1
                option[i] = 1 if at < 0 else 2 if prompts[i][at + len(body) : at + len(body) + 1] in ("", "\n") else 3
        known, n = self._english(w)
        share = np.where(n > 0, 10 * known // np.maximum(n, 1), 10)
        long_ = np.searchsorted([1, 2, 4, 9], n, side="right")
        copied = self.copied(w, Words(prompts))
        broken &= (shape != 1) & (shape != 3)
        full = ~blank
        flags = [
            ("null", null, 1), ("blank", blank, 1), ("notice", notice, 1), ("error", np.array(errors, bool) & ~null, 1), ("whole", whole > 0, whole), ("end", full, shape), ("endbroken", full, 2 * shape + broken),
            ("english", full, 16 * share + long_), ("n", full, long_), ("option", full & (option > 0), option), ("copied", full, 4 * copied + 2 * (w.counts < 4) + ((option > 0) & (n <= 14))),
        ]
        length = np.array([len(t or "") for t in texts])
        flags.append(("chars", full, np.minimum(9, np.ceil(np.log2(length + 1)).astype(np.int64))))
        latin = [-1 if t is None or t.isascii() else 4 * len(_LATIN.findall(t)) // max(1, sum(map(str.isalpha, t))) for t in texts]
        flags.append(("latin", full & (np.array(latin, np.int64) >= 0), np.maximum(0, np.array(latin, np.int64))))
        for name, where, x in flags:
            at = every[where]
            add(bucket(np.broadcast_to(np.asarray(x), len(texts))[where], name), at)
        i, v, r = np.concatenate(index), np.concatenate(value), np.concatenate(row)
        order = np.argsort(r, kind="stable")
        return i[order], v[order], r[order]


class Classifier:
    """One logistic regression per label over the hashed features."""

    def __init__(self) -> None:
        self.w = np.zeros((len(LABELS), BUCKETS), dtype=np.float32)
        self.b = np.full(len(LABELS), -1.0, dtype=np.float32)
        self.thresholds = np.full(len(LABELS), 0.5)

    def scores(self, index: np.ndarray, value: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        z = np.stack([np.bincount(row, self.w[k][index] * value, n) for k in range(len(LABELS))], axis=1) + self.b
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, index: np.ndarray, value: np.ndarray, row: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> None:
        """AdaGrad on shuffled minibatches."""
        n = len(y)
        starts = np.searchsorted(row, np.arange(n + 1))
        seen = np.full_like(self.w, 1e-6)
        seen_b = np.full(len(LABELS), 1e-6)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in range(0, n, 256):
                part = order[at : at + 256]
                lens = starts[part + 1] - starts[part]
                take = np.repeat(starts[part] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
                i, v, r = index[take], value[take], np.repeat(np.arange(len(part)), lens)
                p = self.scores(i, v, r, len(part))
                g = p - y[part]
                u, inverse = np.unique(i, return_inverse=True)
                for k in range(len(LABELS)):
                    grad = np.bincount(inverse, g[r, k] * v, len(u)) + 2e-3 * self.w[k][u]
                    seen[k][u] += grad**2
                    self.w[k][u] -= 0.3 * grad / np.sqrt(seen[k][u])
                seen_b += g.sum(axis=0) ** 2
                self.b -= 0.3 * g.sum(axis=0) / np.sqrt(seen_b)

    def verdicts(self, p: np.ndarray) -> list[str | None]:
        """The defect whose score exceeds its threshold by most, if any."""
        margin = p - self.thresholds
        best = margin.argmax(axis=1)
        return [LABELS[k] if margin[i, k] >= 0 else None for i, k in enumerate(best)]


def _cut(text: str, rng: np.random.Generator) -> str | None:
    """The text up to a random place inside a word or sentence, with something set behind it now and then."""
    if len(text) < 24:
        return None
    at = int(rng.integers(max(8, len(text) // 6), len(text) - 1))
    head = text[:at].rstrip()
    if not head or head[-1] in ".?!…।:#=*\n" or not head[-1].isalnum() or _ANSWER.search(head) or _CLOSED.match(text[at:].lstrip("*")):
        return None
    if not any(c.isalpha() for c in text[at:].split(". ")[0][:40]):
        return None
    return head + str(rng.choice(["", "", "", "", "", "...", "…", " […]", "�", "\n", ","]))


def _altered(text: str, rng: np.random.Generator) -> str:
    """A copy as models give it back: other case, quoted, a question mark lost, a word dropped."""
    k = int(rng.integers(0, 8))
    if k == 0:
        return text.lower()
    if k == 1:
        return text.upper()
    if k == 2:
        return "> " + text
    if k == 3:
        return "Question: " + text
    if k == 4:
        return text.rstrip("?. \n")
    if k == 5:
        w = text.split(" ")
        del w[int(rng.integers(0, len(w)))]
        return " ".join(w)
    return text + "\n" if k == 6 else text


def _question(prompt: str) -> str:
    return prompt.split("\n\n")[0]


def _last_sentence(prompt: str) -> str:
    return re.split(r"(?<=[.?!])\s+", _question(prompt).strip())[-1]


def _pick(rng: np.random.Generator, options: list[str]) -> str:
    return options[int(rng.integers(0, len(options)))]


def _refusal(rng: np.random.Generator) -> str:
    """A refusal by the grammar, one or two sentences."""

    def one() -> str:
        slots = _pick(rng, REFUSALS.strip().splitlines()).split()
        words = " ".join(_pick(rng, SLOTS[x].split("|")) if x in SLOTS else x.lower() for x in slots).replace(" '", "'").strip(" ,:")
        words = re.sub(r"\s+", " ", words)
        return words[:1].upper() + words[1:] + _pick(rng, [".", ".", ".", "!", ""])

    return one() if rng.random() < 0.6 else one().rstrip(".!") + ". " + one()


def _foreign(rng: np.random.Generator) -> str:
    """Words of one language in any order, with numbers between them, as a short answer or some sentences."""
    words = _pick(rng, FOREIGN.strip().splitlines()).split()
    joint = "" if words[0] in "的の" else " "

    def sentence(n: int) -> str:
        some = [_pick(rng, words) for _ in range(n)]
        for k in range(len(some)):  # other forms of words: parts of two put together
            if rng.random() < 0.4:
                some[k] += _pick(rng, words)[-3:]
        if rng.random() < 0.5:
            some.insert(int(rng.integers(0, len(some) + 1)), _pick(rng, ["A", "B", "C", "D", str(rng.integers(1, 900)), str(rng.integers(1, 900))]))
        text = joint.join(some)
        return text[:1].upper() + text[1:]

    if rng.random() < 0.35:
        t = sentence(int(rng.integers(1, 4)))
        return t.lower() if rng.random() < 0.6 else t
    text = " ".join(sentence(int(rng.integers(4, 12))) + _pick(rng, [".", ".", ".", "。" if not joint else "."]) for _ in range(int(rng.integers(1, 4))))
    return text + (f"\n#### {rng.integers(1, 900)}" if rng.random() < 0.2 else "")


def train(rows: list[dict], vocabulary: Vocabulary, seed: int = 11) -> Classifier:
    """Fit on up to TRAIN_ROWS rows of audit_pairs and the defects made from them."""
    rng = np.random.default_rng(seed)
    prompts = [p for r in rows for p in (r["original_prompt"], r["transformed_prompt"]) if p]
    feats = Features(vocabulary)
    sound: list[tuple[str, str | None, str, bool]] = []
    refused: list[tuple[str, str | None, str, bool]] = []
    for r in rows:
        for side in ("original", "transformed"):
            t, p = r[f"{side}_response"], r[f"{side}_prompt"]
            if not t or _BLANK.fullmatch(t) or _NOTICE.fullmatch(t):
                continue
            item = (t, p, f"{side}_response", bool(r["error"]))
            (refused if r[f"{side}_answer"] == "refused" else sound).append(item)
    w, q = Words([x[0] for x in sound]), Words([x[1] for x in sound])
    (known, n), copied = feats._english(w), feats.copied(w, q)
    strange = (n >= 2) & (known < 0.5 * n) | (w.counts >= 5) & (copied >= 8) & np.array([not _OPTION.match(x[0]) for x in sound], bool)
    sound = [x for x, bad in zip(sound, strange) if not bad]

    def made() -> list[tuple[str | None, str | None, str, bool, str | None]]:
        out: list[tuple[str | None, str | None, str, bool, str | None]] = [(*s, None) for s in sound]
        for t, p, f, e in sound:
            for _ in range(2):
                if cut := _cut(t, rng):
                    out.append((cut, p, f, e or rng.random() < 0.02, "truncated"))
            if t.rstrip().endswith(".") and rng.random() < 0.25:
                out.append((t.rstrip()[:-1], p, f, e, None))
            whole = re.split(r"(?<=[.?!])\s+", t)
            if len(whole) > 2 and rng.random() < 0.3:
                out.append((" ".join(whole[:-1]), p, f, e, None))
            if p and rng.random() < 0.25:
                part = [p, _question(p), _last_sentence(p)][int(rng.integers(0, 3))]
                if len(part.split()) >= 5:
                    out.append((_altered(part, rng), p, f, e, "copy"))
            if p and rng.random() < 0.08:  # a reply to another prompt is no copy of this one
                out.append((t, prompts[int(rng.integers(0, len(prompts)))], f, e, None))
            if rng.random() < 0.25:
                out.append((_refusal(rng), p, f, e, "refusal"))
            if rng.random() < 0.2:
                out.append((_foreign(rng), p, f, e, "language"))
            if rng.random() < 0.06:
                pool = PLACEHOLDERS if rng.random() < 0.7 else NOTICES
                out.append((str(rng.choice(pool)), p, f, rng.random() < 0.3, "empty"))
        out += [(*s, "refusal") for s in refused]
        for r in rows:
            q, a = r["transformed_prompt"], r["transformed_answer"]
            if a and len(a) < 40 and (len(a) <= 1 or a in ("complied", "refused") or re.fullmatch(r"[-\d.,]+", a)) and rng.random() < 0.4:
                out.append((a, q, "transformed_answer", False, None))
            if q and rng.random() < 0.1:
                out.append((_altered(_question(q), rng), q, "transformed_answer", False, "copy"))
            if rng.random() < 0.1:
                out.append((_foreign(rng), q, "transformed_answer", False, "language"))
            if rng.random() < 0.04:
                out.append((str(rng.choice(PLACEHOLDERS)), q, "transformed_answer", False, "empty"))
        return out

    def arrays(items: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts, y = [], []
        at = 0
        for field in sorted({x[2] for x in items}):
            some = [x for x in items if x[2] == field]
            i, v, r = feats.rows([x[0] for x in some], [x[1] for x in some], field, [x[3] for x in some])
            parts.append((i, v, r + at))
            at += len(some)
            y += [[float(x[4] == lab) for lab in LABELS] for x in some]
        i, v, r = (np.concatenate(x) for x in zip(*parts))
        return i, v, r, np.array(y)

    model = Classifier()
    if not sound:
        return model
    turns = 3
    for turn in range(turns):
        model = Classifier()
        items = made()
        order = rng.permutation(len(items))
        held = len(items) // 6
        i, v, r, y = arrays([items[k] for k in order[held:]])
        model.fit(i, v, r, y)
        if turn < turns - 1:  # real defects among the replies taken for sound leave them
            i, v, r = feats.rows([s[0] for s in sound], [s[1] for s in sound], "original_response", [s[3] for s in sound])
            p = model.scores(i, v, r, len(sound))
            refused += [s for s, x in zip(sound, p) if x[LABELS.index("refusal")] >= 0.8]
            sound = [s for s, x in zip(sound, p) if x.max() < 0.5]
            continue
        i, v, r, y = arrays([items[k] for k in order[:held]])
        p = model.scores(i, v, r, len(y))
        for k in range(len(LABELS)):
            best = (-1.0, 0.5)
            for c in np.arange(0.2, 0.85, 0.05):
                hit = p[:, k] >= c
                tp = float((hit & (y[:, k] > 0)).sum())
                f1 = 2 * tp / max(1.0, hit.sum() + y[:, k].sum())
                best = max(best, (f1 - 0.002 * abs(c - 0.5), float(c)))
            model.thresholds[k] = best[1]
    return model


_OUT = "audit_key bigint, model string, field string, defect string"
_READ = ["audit_key", "model", "original_prompt", "transformed_prompt", "original_response", "transformed_response", "original_answer", "transformed_answer", "error"]


def sample(audits: DataFrame, limit: int = TRAIN_ROWS) -> list[dict]:
    """Up to ``limit`` rows for training, spread over the table by hash of the key."""
    n = audits.count()
    thin = max(1, n // (2 * limit))
    some = audits.select(*_READ).where(F.pmod(F.xxhash64("audit_key"), F.lit(thin)) == 0)
    return [r.asDict() for r in some.orderBy(F.xxhash64("audit_key", F.lit(1))).limit(limit).collect()]


def classify(audits: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """One row per value with its defect, null if it has none: audit_key, model, field, defect.

    Fields are original_response and transformed_response, and
    transformed_answer where transformed_response is sound, for which only
    empty, copy and language count.  Null values are empty; repeated rows give
    their rows each.
    """
    words = vocabulary(audits)
    model = train(sample(audits, limit), words)
    shared = audits.sparkSession.sparkContext.broadcast((model, words))  # a fixed number of weights, at most 1 / SHARE words and their beginnings
    answers = [LABELS.index(x) for x in ("empty", "language", "copy")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, voc = shared.value
        feats = Features(voc)
        text = lambda s: [x if isinstance(x, str) else None for x in s]
        for whole in bounded(batches, ["original_prompt", "transformed_prompt", "original_response", "transformed_response", "transformed_answer"]):
            for at in range(0, len(whole), 2_000):
                pdf = whole.iloc[at : at + 2_000]
                errors = [isinstance(x, str) and x != "" for x in pdf["error"]]
                out = []
                for side in ("original", "transformed"):
                    f = f"{side}_response"
                    i, v, r = feats.rows(text(pdf[f]), text(pdf[f"{side}_prompt"]), f, errors)
                    out.append(pd.DataFrame({"audit_key": pdf["audit_key"].to_numpy(), "model": pdf["model"].to_numpy(), "field": f, "defect": m.verdicts(m.scores(i, v, r, len(pdf)))}))
                sound = out[1]["defect"].isna().to_numpy()
                some = pdf[sound]
                i, v, r = feats.rows(text(some["transformed_answer"]), text(some["transformed_prompt"]), "transformed_answer", [False] * len(some))
                p = m.scores(i, v, r, len(some))
                for k in range(len(LABELS)):
                    if k not in answers:
                        p[:, k] = -1.0
                out.append(pd.DataFrame({"audit_key": some["audit_key"].to_numpy(), "model": some["model"].to_numpy(), "field": "transformed_answer", "defect": m.verdicts(p)}))
                yield pd.concat(out, ignore_index=True)

    return audits.select(*_READ).mapInPandas(run, _OUT)


def rates(values: DataFrame, by: list[str]) -> DataFrame:
    """Values and defective values of each kind per group."""
    return values.groupBy(*by).agg(F.count("*").alias("values"), *[F.count_if(F.col("defect") == d).alias(d) for d in sorted(LABELS)])
