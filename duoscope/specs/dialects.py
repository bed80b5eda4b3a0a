"""Built-in dialect specifications, and a loader for specifications in YAML files."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path


@dataclass(frozen=True)
class Feature:
    """A dialect feature: found where any of its patterns is."""

    id: str
    name: str
    priority: str
    patterns: tuple[str, ...]


@dataclass(frozen=True)
class Dialect:
    """Features, phrases to avoid, and the patterns that speak for or against authenticity."""

    code: str
    name: str
    features: tuple[Feature, ...]
    avoid: tuple[str, ...] = ()
    stereotypes: tuple[str, ...] = ()
    suspicious: tuple[str, ...] = ()
    markers: tuple[str, ...] = ()
    prompts: dict[str, str] = field(default_factory=dict)

    @property
    def high_priority(self) -> list[str]:
        return [f.id for f in self.features if f.priority == "high"]

    def feature(self, feature_id: str) -> Feature | None:
        return next((f for f in self.features if f.id == feature_id), None)


# The patterns of each dialect.
HIBERNO_ENGLISH = Dialect(
    code="hiberno_english",
    name="Hiberno-English",
    features=(
        Feature("perfective_after", "Perfective 'after' construction", "high", (
            r"\bafter\s+\w+ing\b",
            r"\b(?:I'm|I am|he's|she's|it's|we're|they're|you're)\s+after\s+\w+ing\b",
            r"\b(?:is|am|are|was|were)\s+after\s+\w+ing\b",
            r"\bhad\s+been\s+after\s+\w+ing\b",
            r"\b(?:isn't|aren't|wasn't)\s+after\s+\w+ing\b",
        )),
        Feature("habitual_do_be", "Habitual 'do be' construction", "high", (
            r"\b(?:do|does|did)\s+be\s+\w+ing\b",
            r"\b(?:don't|doesn't)\s+be\s+\w+ing\b",
            r"\b(?:do|does)\s+be\s+\w+(?:ed|t)?\b",
        )),
        Feature("amnt_contraction", "'Amn't' contraction", "medium", (r"\bamn't\b",)),
        Feature("youse_plural", "Second person plural 'youse/ye'", "medium", (r"\byouse\b", r"\bye\b(?!\s+olde)")),
        Feature("sure_discourse", "'Sure' as discourse marker", "medium", (
            r"^[Ss]ure,?\s+",
            r"\b[Ss]ure,?\s+(?:wasn't|isn't|aren't|don't|doesn't)",
            r"(?:^|[.!?]\s+)[Ss]ure,?\s+",
            r",\s+[Ss]ure,?\s+",
        )),
        Feature("cleft_emphasis", "Cleft sentences for emphasis", "high", (
            r"\b[Ii]t's\s+\w+\s+(?:I|he|she|we|they|you)\s+(?:am|is|are|was|were)\b",
            r"\b[Ii]t's\s+.+?\s+that\s+",
        )),
        Feature("reflexive_reference", "Reflexive pronoun for emphasis", "low", (
            r"\b(?:[Hh]imself|[Hh]erself)\s+(?:said|told|came|went|is|was)",
            r"\b[Ii]s\s+(?:himself|herself)\b",
        )),
        Feature("for_to_infinitive", "'For to' infinitive", "medium", (r"\bfor\s+to\s+\w+\b",)),
        Feature("embedded_inversion", "Embedded question inversion", "medium", (
            r"\b(?:wonder|know|ask|see|tell|think|suppose)\s+(?:is|are|was|were|has|have|did|does|do|will|would|can|could)\s+(?:he|she|it|they|we|you|I)\b",
        )),
        Feature("and_subject_gerund", "'And' + subject + gerund narrative", "low", (r"\b[Aa]nd\s+(?:me|him|her|them|us)\s+\w+ing\b",)),
        Feature("after_noun_plural", "Plural after numerals", "low", (r"\b(?:two|three|four|five|six|seven|eight|nine|ten|\d+)\s+(?:mile|pound|year|foot|stone)\b",)),
        Feature("so_it_is", "Tag 'so it is/so I did'", "medium", (
            r",?\s+so\s+(?:it|I|he|she|we|they)\s+(?:is|am|are|was|were|did|do|does)(?:\.|,|!|$)",
            r",?\s+so\s+(?:it|he|she)\s+does(?:\.|,|!|$)",
        )),
        Feature("tis_contraction", "'Tis contraction", "medium", (r"\b[''']?[Tt]is(?:n't)?\b",)),
        Feature("grand_colloquial", "'Grand' as positive/fine", "low", (r"\b(?:that's|it's|you're|I'm|he's|she's)\s+grand\b", r"\b\d+\s+grand\b")),
        Feature("fierce_intensifier", "'Fierce' as intensifier", "low", (r"\bfierce\s+\w+",)),
    ),
    avoid=("Top o' the morning", "Begorrah", "Faith and begorrah", "To be sure, to be sure", "Excessive leprechaun speak", "Random apostrophes to suggest accent", "Oirish spellings"),
    stereotypes=(
        r"\btop o[f']? the mornin", r"\bbegorrah\b", r"\bfaith and begorrah\b", r"\bto be sure,? to be sure\b", r"\bbegorra\b", r"\boch\s+aye\b", r"\blassie\b", r"\bladdie\b",
        r"\bme darlin[g']?\b", r"\bwee bit o[f']?\b", r"\bpotato famine\b", r"\bleprechaun\b", r"\bpot o[f']? gold\b", r"\bshamrock\b", r"\bpaddy\b", r"\bmick\b",
    ),
    suspicious=(
        r"\b[a-z]+'[a-z]+\b.*\b[a-z]+'[a-z]+\b.*\b[a-z]+'[a-z]+\b.*\b[a-z]+'[a-z]+\b",
        r"\baye\b.*\baye\b.*\baye\b",
        r"!{3,}",
    ),
    markers=(
        r"\bafter\s+\w+ing\b", r"\b(?:do|does)\s+be\s+\w+ing\b", r"\bamn't\b", r"\byouse\b", r"\bye\b", r"(?:^|[.!?]\s+)[Ss]ure,?\s+",
        r",?\s+so\s+(?:it|I|he|she|we|they)\s+(?:is|am|are|was|were|did|do|does)", r"\bfor\s+to\s+\w+\b", r"\b[Ii]t's\s+\w+\s+(?:I|he|she|we|they)\s+(?:am|is|are)\b",
        r"\bgrand\b", r"\bfierce\s+\w+", r"\b[''']?[Tt]is\b",
    ),
)

AAVE = Dialect(
    code="aave",
    name="African American Vernacular English",
    features=(
        Feature("habitual_be", "Habitual/Invariant 'be'", "high", (
            r"\b(?:I|he|she|it|we|they|you)\s+be\s+\w+ing\b",
            r"\b(?:I|he|she|it|we|they|you)\s+be\s+\w+(?:ed)?\b",
        )),
        Feature("copula_deletion", "Copula deletion", "high", (
            r"\b(?:he|she|it|they|we|you)\s+(?:nice|ready|good|bad|tired|hungry|busy|crazy|fine|cool|real|right|wrong|happy|sad|mad|sick|smart|funny|big|small|old|young|new|fast|slow|hot|cold|late|early|hard|easy|loud|quiet|clean|dirty|safe|wild|free|strong|weak|tall|short|rich|poor|mean|kind|true|fair|dark|light)\b",
            r"\b(?:he|she|it)\s+my\s+\w+\b",
            r"\b(?:he|she|it|they|we|you)\s+(?:a|the|gonna|about\s+to|over\s+there|in\s+the|at\s+the|on\s+the)\b",
        )),
        Feature("completive_done", "Completive 'done'", "high", (
            r"\b(?:I|he|she|it|we|they|you)\s+done\s+\w+(?:ed)?\b",
            r"\b(?:I|he|she|it|we|they|you)\s+done\s+(?:went|ate|saw|came|got|left|told|gave|took|made)\b",
        )),
        Feature("remote_past_been", "Remote past 'been' (stressed BIN)", "medium", (r"\b(?:I|he|she|it|we|they|you)\s+been\s+(?:knew|had|done|finished|married|told|seen)\b",)),
        Feature("aint_negation", "'Ain't' as negator", "medium", (r"\bain't\b",)),
        Feature("negative_concord", "Negative concord (multiple negation)", "medium", (
            r"\bain't\s+got\s+no\b",
            r"\bdon't\s+(?:got|know|want|need)\s+no(?:thing|body|where)?\b",
            r"\bnobody\s+don't\b",
            r"\bno\s+\w+\s+(?:never|no)\b",
        )),
        Feature("finna_future", "'Finna' for immediate future", "medium", (r"\bfinna\s+\w+\b",)),
        Feature("existential_it", "Existential 'it'", "low", (r"\b[Ii]t's\s+(?:a|an|some|two|three|four|five|\d+)\s+\w+\s+(?:at|in|on|by|near)\b",)),
        Feature("aspectual_steady", "Aspectual 'steady'", "low", (r"\bsteady\s+\w+ing\b",)),
        Feature("come_indignation", "'Come' for indignation", "low", (r"\b(?:he|she|they|you)\s+come\s+\w+ing\b",)),
        Feature("possessive_they", "'They' as possessive", "low", (r"\bthey\s+(?:house|car|mama|daddy|brother|sister|friend|stuff|thing|money|place)\b",)),
        Feature("third_person_dont", "Uninflected 'don't'", "medium", (r"\b(?:he|she|it)\s+don't\b",)),
    ),
    avoid=("Excessive apostrophes to mark 'accent'", "Minstrel-style exaggerations", "Random misspellings", "Mixing with Caribbean or African dialects", "Exaggerated slang not part of authentic AAVE"),
    stereotypes=(r"\byo\s+yo\s+yo\b", r"\bhomie\b.*\bhomie\b", r"\bword\s+up\b", r"\bknow\s+what\s+I'm\s+sayin[g']?\b", r"\bpeace\s+out\b"),
    suspicious=(r"\b[a-z]+'[a-z]+\b.*\b[a-z]+'[a-z]+\b.*\b[a-z]+'[a-z]+\b.*\b[a-z]+'[a-z]+\b", r"\bda\b", r"\bdis\b", r"\bdat\b"),
    markers=(
        r"\b(?:he|she|they|we|I|you|it)\s+be\s+\w+ing\b", r"\b(?:I|he|she|they|we|you|it)\s+done\s+\w+", r"\bain't\b", r"\bain't\s+got\s+no\b", r"\b(?:he|she|it)\s+don't\b", r"\bfinna\b", r"\bsteady\s+\w+ing\b",
        r"\b(?:I|he|she|they|we)\s+been\s+(?:knew|had|done|finished|married)\b", r"\bthey\s+(?:house|car|mama|stuff|money)\b", r"\bdon't\s+(?:got|know|want|need)\s+no\b",
    ),
)

INDIAN_ENGLISH = Dialect(
    code="indian_english",
    name="Indian English",
    features=(
        Feature("progressive_stative", "Progressive aspect with stative verbs", "high", (
            r"\b(?:am|is|are|was|were)\s+(?:knowing|understanding|having|thinking|believing|wanting|needing|liking|loving|belonging|owning|possessing|meaning|hoping|seeing|hearing|remembering|forgetting|realizing|supposing)\b",
        )),
        Feature("invariant_tag", "Invariant tag questions ('isn't it', 'no', 'na')", "high", (r",\s*isn't\s+it\s*[?]?$", r",\s*no\s*[?]?$", r",\s*na\s*[?]?$")),
        Feature("only_emphasis", "'Only' for emphasis/focus", "high", (
            r"\b(?:I|he|she|they|we|you|this|that|here|there|now|today|yesterday)\s+only\b",
            r"\b\w+\s+only\s+(?:is|are|was|were|told|said|came|went|did)\b",
        )),
        Feature("itself_emphasis", "'Itself/himself/herself' for emphasis", "high", (
            r"\b(?:now|today|tomorrow|yesterday|here|there|this|that)\s+itself\b",
            r"\b(?:same|very)\s+\w+\s+itself\b",
        )),
        Feature("reduplication", "Reduplication for emphasis/intensity", "medium", (r"\b(hot|cold|big|small|fast|slow|good|bad|same|now|quick)\s+\1\b",)),
        Feature("article_variation", "Article usage variation", "medium", (
            r"\b(?:is|are|am|was|were|become|became)\s+(?:teacher|doctor|engineer|student|professor|manager|scientist)\b(?!\s+(?:of|at|in|who|that))",
        )),
        Feature("prepositional_variation", "Non-standard preposition usage", "medium", (r"\b(?:discuss|explain|describe|emphasize|stress)\s+about\b", r"\b(?:order|request|demand)\s+(?:for|to)\s+\w+\b")),
        Feature("present_perfect_variation", "Present perfect for recent past", "medium", (r"\b(?:have|has)\s+(?:taken|finished|completed|done|reached|come|gone)\s+(?:just|already|now)\b",)),
        Feature("would_politeness", "'Would' for politeness/formality", "low", (r"\bwould\s+(?:like|request|suggest|advise|recommend)\s+(?:to|you|that)\b",)),
        Feature("continuous_for_simple", "Continuous tense for simple aspect", "medium", (r"\b(?:am|is|are)\s+(?:thinking|wanting|needing|meaning|hoping)\s+(?:so|that|about)\b",)),
        Feature("verb_agreement_variation", "Subject-verb agreement variation", "low", (r"\b(?:team|committee|government|staff|family|management)\s+(?:are|have|were)\b",)),
        Feature("one_determiner", "'One' as determiner/intensifier", "low", (r"\b(?:one|what\s+one)\s+(?:headache|problem|mess|confusion|tension)\b",)),
    ),
    avoid=(
        "Excessive 'Sir' or 'Madam' in every sentence", "'Please do the needful' (though used, has become a stereotype)", "Apu-style accent markers or phonetic spellings", "Excessive 'kindly' usage",
        "Head wobble or cultural stereotype references", "Random Hindi/Urdu words mixed in", "'Very very' as the only form of emphasis", "Overly formal colonial-era phrasing", "'Good name' for 'name'",
    ),
    stereotypes=(r"\bdo\s+the\s+needful\b", r"\bkindly\s+revert\b", r"\bgood\s+name\b", r"\bsir\s+ji\b", r"\bvery\s+very\s+very\b", r"\bplease\s+to\s+be\b", r"\bmy\s+friend\s+is\s+telling\s+me\b"),
    suspicious=(r"\bji\b.*\bji\b.*\bji\b", r"\bsir\b.*\bsir\b.*\bsir\b", r"\bmadam\b.*\bmadam\b", r"\bkindly\b.*\bkindly\b"),
    markers=(
        r"\b(?:am|is|are|was|were)\s+(?:knowing|understanding|having|thinking|believing|wanting|needing|liking|loving)\b", r",\s*isn't\s+it\s*[?]?$", r",\s*no\s*[?]?$", r",\s*na\s*[?]?$",
        r"\b(?:I|he|she|they|this|that|now|today|yesterday|here|there)\s+only\b", r"\b(?:now|today|tomorrow|yesterday|here|there|this|that)\s+itself\b", r"\b(hot|cold|fast|slow|same|good|big|small|quick)\s+\1\b",
        r"\b(?:discuss|explain|describe)\s+about\b", r"\b(?:order|request)\s+for\b", r"\b(?:have|has)\s+(?:taken|finished|completed|done|reached)\s+(?:just|already|now)\b", r"\bwould\s+(?:like|request|suggest)\s+to\b",
    ),
)

def _prompts(name: str, speakers: str, hints: str) -> dict[str, str]:
    """The three templates of a built-in dialect."""
    return {
        "system": f"You know {name} as {speakers} speak it. You restate Standard American English in {name}. Meaning, numbers, names and any question stay exactly as they are; you never answer, solve or explain. Write naturally, without stereotypes or invented spelling. {hints}",
        "user_template": f"Restate this text in {name}. Give the restated text and nothing else.\n\n{{text}}",
        "batch_template": f"Restate each of these numbered texts in {name}. Keep the numbers and the order, one text a line, and give nothing else.\n\n{{texts}}",
    }


_PROMPTS = {
    "hiberno_english": _prompts("Hiberno-English", "people in Ireland", "Fitting features are the 'after' perfect, habitual 'do be', 'ye' and 'youse', and cleft sentences, where they come of themselves."),
    "aave": _prompts("African American Vernacular English", "its native speakers", "Fitting features are habitual 'be', zero copula, 'been' for the remote past and negative concord, used by their own grammar."),
    "indian_english": _prompts("Indian English", "educated speakers in India", "Fitting features are the progressive with verbs of state, 'only' and 'itself' for emphasis, and tag questions such as 'isn't it', where they come of themselves."),
}

DIALECTS = {d.code: replace(d, prompts=_PROMPTS[d.code]) for d in (HIBERNO_ENGLISH, AAVE, INDIAN_ENGLISH)}


def load_dialect(code: str, directory: str | None = None, judge: bool = False) -> Dialect:
    """The built-in specification, or ``{directory}/{code}.yaml``: adding a file adds a dialect.

    A missing file raises FileNotFoundError, one without features ValueError,
    and so does one without an authenticity section where ``judge`` asks for it.
    """
    if directory is None:
        if code not in DIALECTS:
            raise FileNotFoundError(f"no dialect named {code}; there are {', '.join(sorted(DIALECTS))}")
        return DIALECTS[code]
    import yaml

    path = Path(directory) / f"{code}.yaml"
    if not path.exists():
        raise FileNotFoundError(str(path))
    spec = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    if "features" not in spec:
        raise ValueError(f"{path} declares no features")
    judged = spec.get("authenticity") or {}
    if judge and not judged:
        raise ValueError(f"{path} declares no authenticity section")
    return Dialect(
        code=spec.get("dialect_code", code),
        name=spec.get("dialect_name", code),
        features=tuple(Feature(k, f.get("name", k), f.get("priority", "medium"), tuple(f.get("patterns", ()))) for k, f in spec["features"].items()),
        avoid=tuple(spec.get("avoid_features", ())),
        stereotypes=tuple(judged.get("stereotype_patterns", ())),
        suspicious=tuple(judged.get("suspicious_patterns", ())),
        markers=tuple(judged.get("authentic_markers", ())),
        prompts={k: str(v).strip() for k, v in (spec.get("prompts") or {}).items()},
    )


def require_prompts(dialect: Dialect) -> dict[str, str]:
    """The three prompt templates of a specification; ValueError if one is missing."""
    missing = [k for k in ("system", "user_template", "batch_template") if k not in dialect.prompts]
    if missing:
        raise ValueError(f"{dialect.code} has no prompt {', '.join(missing)}")
    return dialect.prompts


def prompt_dialects(directory: str | None = None) -> list[Dialect]:
    """The dialects that have all three prompts, built in or below a directory, by code."""
    codes = sorted(DIALECTS) if directory is None else sorted(p.stem for p in Path(directory).glob("*.yaml"))
    every = [load_dialect(c, directory) for c in codes]
    return [d for d in every if {"system", "user_template", "batch_template"} <= set(d.prompts)]
