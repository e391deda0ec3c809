"""Text columns: tokens, similarities, names and labels. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Keywords of the delivery classes, in order of precedence.
DELIVERY = (("laughter", ("laugh", "chuckle", "giggle")), ("high_energy", ("shout", "yell", "scream", "cheer")), ("soft", ("whisper", "murmur", "soft", "quietly")))
# Tokens that show how many speak; the first set is tried first.
SPEAKER_MODES = (("multi_speaker", ("conversation", "dialogue", "talking", "speakers")), ("single_speaker", ("narration", "monologue", "speaking", "speech")))
# Words for people in a label, and the labels' default keywords.
PEOPLE = ("people", "person", "man", "woman", "boy", "girl", "human", "crowd", "audience", "child", "adult")
KEYWORDS = ("hammer", "clap", "slap", "slam", "bang", "smash", "knock", "hit", "punch", "thud")
# Fixed value: words that a clip shown to people must not hold.
PROFANITY = r"(?i)\b(fuck|fucking|shit|bitch|cunt|dick|asshole)\b"
# Openings that ask for a repetition or for what was meant, and what a cue clip scores for a good length, for safe
# words, and for an opening that tells of its label.
REPAIR = r"(?i)^(what was that|what did you say|can you repeat|could you repeat|i didn.?t hear|i didn.?t catch|huh|pardon|sorry what)"
CLARIFY = r"(?i)^(what do you mean|which one|who do you mean|do you mean|are you saying|can you clarify|could you clarify)"
CUE_POINTS = {"length": 5, "safe": 3, "explicit_repair_cue_detection": 8, "clarification_question_detection": 8, "acknowledgment_cue_detection": 6}
# Fixed value: messages with these words are left out of prompts.
SKIPPED = "Sometimes, the user may need"
# Answers without and with context that differ tellingly, and words for physical surroundings.
CONTRASTS = (("respond", "avoid"), ("respond", "not respond"), ("answer", "clarify"), ("do", "repeat"), ("confident", "uncertain"))
SURROUNDINGS = ("bystander", "side conversation", "nearby", "distance", "angle", "noise", "noisy", "traffic", "vehicle", "public", "room", "construction", "music", "unclear", "repeat", "clarify")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"[\p{L}\p{N}]+"), 0)


def ascii_terms(text) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z0-9]+"), 0)


def squeeze(text) -> Column:
    """White space collapsed and cut off at both ends."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def overlap(a: Column, b: Column) -> Column:
    """Share of common tokens among all, 0 if a side has none."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def multiset_similarity(a: Column, b: Column) -> Column:
    """Common tokens counted with their multiplicity, over the longer side's number; for short texts."""
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(F.size(F.filter(a, lambda z: z == w)), F.size(F.filter(b, lambda z: z == w))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / F.greatest(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def slug(text, default: str = "item") -> Column:
    """Lower case, other characters as single underscores; the default if nothing is left."""
    made = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(text))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(made == "", default).otherwise(made)


def file_slug(text, most: int = 80) -> Column:
    """Keeps case, dots and dashes; at most ``most`` characters."""
    made = F.substring(F.regexp_replace(F.regexp_replace(col(text), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), 1, most)
    return F.when(made == "", "item").otherwise(made)


def last_integer(text) -> Column:
    found = F.regexp_extract_all(col(text), F.lit("[0-9]+"), 0)
    return F.coalesce(F.try_element_at(found, F.lit(-1)).try_cast("long"), F.lit(0).cast("long"))


def first_integer(text) -> Column:
    return F.regexp_extract(col(text), "-?[0-9]+", 0).try_cast("long")


def video_id(name, short: bool = False) -> Column:
    """What stands before the frame size, or else before the ``_full_video`` mark; with ``short``, before the first
    underscore."""
    sized = F.regexp_extract(col(name), r"^(.+?)_[0-9]+x[0-9]+_full_video_?", 1)
    return F.when(sized != "", sized).otherwise(F.split_part(col(name), F.lit("_" if short else "_full_video"), F.lit(1)))


def letters(text, valid: list[str]) -> Column:
    """Distinct valid letters by first occurrence, in whatever words they stand."""
    allowed = F.array(*map(F.lit, valid))
    return F.array_distinct(F.filter(F.split(F.upper(col(text)), ""), lambda c: F.array_contains(allowed, c)))


def delivery(text) -> Column:
    out, lower = F.lit("neutral_speech"), F.lower(col(text))
    for name, words in reversed(DELIVERY):
        out = F.when(lower.rlike("|".join(words)), name).otherwise(out)
    return out


def duration_bucket(seconds) -> Column:
    return F.when(col(seconds) < 2.5, "short").when(col(seconds) < 5.0, "medium").otherwise("long")


def speaker_count_label(n) -> Column:
    return F.when(col(n) > 1, "multiple_speakers").otherwise("single_speaker")


def speaker_mode(text) -> Column:
    own = tokens(text)
    out = F.lit("unknown")
    for name, words in reversed(SPEAKER_MODES):
        out = F.when(F.arrays_overlap(own, F.array(*map(F.lit, words))), name).otherwise(out)
    return out


def safe_event(*values) -> Column:
    """The first value that isn't blank, squeezed, with underscores, in lower case."""
    first = F.coalesce(*(F.nullif(squeeze(v), F.lit("")) for v in values), F.lit("unknown event"))
    return F.lower(F.replace(first, F.lit(" "), F.lit("_")))


def people_priority(label) -> Column:
    return F.lower(col(label)).rlike("|".join(PEOPLE)).cast("int")


def matches_keywords(label, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    """Whether any keyword stands in the label, also inside a word."""
    lower = F.lower(col(label))
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(lower, k))


def is_safe(text) -> Column:
    return ~F.coalesce(col(text), F.lit("")).rlike(PROFANITY)


def contrast_score(without, with_) -> Column:
    """3 for each telling pair, 1 for each new word of surroundings, 1 for any difference."""
    a, b = F.lower(col(without)), F.lower(col(with_))
    out = F.when(F.trim(a) != F.trim(b), 1).otherwise(0)
    for x, y in CONTRASTS:
        out = out + F.when(F.contains(a, F.lit(x)) & F.contains(b, F.lit(y)), 3).otherwise(0)
    for w in SURROUNDINGS:
        out = out + (F.contains(b, F.lit(w)) & ~F.contains(a, F.lit(w))).cast("int")
    return out


def option_lines(options: Column) -> Column:
    """``A. first`` and so on, a line each."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n")


def compact_prompt(messages: Column, limit: int = 700, skip: str = SKIPPED) -> Column:
    """Messages (role, content) as lines, long ones cut at 260 characters, some left out; the last ``limit`` characters."""
    kept = F.filter(messages, lambda m: ~F.contains(F.coalesce(m["content"], F.lit("")), F.lit(skip)))
    cut = lambda t: F.when(F.length(t) > 260, F.concat(F.substring(t, 1, 260), F.lit("..."))).otherwise(t)
    lines = F.transform(kept, lambda m: F.concat(F.coalesce(m["role"], F.lit("message")), F.lit(": "), cut(F.coalesce(m["content"], F.lit("")))))
    return F.right(F.array_join(lines, "\n"), F.lit(limit))


def bullets(pairs: list[tuple[str, Column]], skip: str = "N/A") -> Column:
    """``- name: value`` lines; unknown for null, none at all for the skipped value."""
    lines = [F.when(v.isNull() | (v != skip), F.concat(F.lit(f"- {name}: "), F.coalesce(v, F.lit("unknown")))) for name, v in pairs]
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")


def unfenced(text) -> Column:
    """A reply without its code fence."""
    return F.regexp_replace(F.trim(col(text)), r"^```[a-zA-Z]*\s*|\s*```$", "")


def reply(text) -> Column:
    """A reply's JSON as struct(decision, reason); other text becomes the reason of an unknown decision."""
    parsed = F.from_json(unfenced(text), "decision string, reason string")
    return F.when(parsed["decision"].isNotNull(), parsed).otherwise(F.struct(F.lit("unknown").alias("decision"), F.trim(col(text)).alias("reason")))


def narration(text) -> Column:
    return F.coalesce(F.nullif(squeeze(text), F.lit("")), F.lit("None."))


def row_context(prompt, query_text) -> Column:
    return F.trim(F.coalesce(F.nullif(col(prompt), F.lit("")), F.nullif(col(query_text), F.lit("")), F.lit("")))


def controlled_signature(count, delivery_, talking, bucket) -> Column:
    return F.concat_ws("|", col(count).cast("string"), col(delivery_), col(talking).cast("string"), col(bucket))


def four_decimals(value) -> Column:
    """Half to even; text that isn't a number as it is, empty for null."""
    number = col(value).try_cast("double")
    return F.coalesce(F.replace(F.format_number(number, 4), F.lit(","), F.lit("")), col(value).cast("string"), F.lit(""))


def event_phrase(name) -> Column:
    return F.replace(col(name), F.lit("_"), F.lit(" "))


def group_key(name) -> Column:
    """The first part of a name; all names of people are one group."""
    first = F.split_part(col(name), F.lit("_"), F.lit(1))
    return F.when(F.startswith(col(name), F.lit("people_")), "people").otherwise(first)


def long_context(dataset, primary, secondary, mode) -> tuple[Column, Column]:
    """What is said of a long item, in brief and at length; secondary events that are empty and unknown modes aren't said."""
    # The sentences.
    first, second = event_phrase(primary), event_phrase(secondary)
    name, how = (F.lit(dataset) if isinstance(dataset, str) else dataset), col(mode)
    short = F.concat(F.lit("A long-form audio clip involving "), first, F.lit("."))
    bits = [F.concat(F.lit("A long-form clip from "), name), F.concat(F.lit("where "), first, F.lit(" is central")), F.when(col(secondary) != "", F.concat(F.lit("and may co-occur with "), second)), F.when(how != "unknown", F.concat(F.lit("with a "), event_phrase(how), F.lit(" interaction pattern")))]
    return short, F.concat(F.concat_ws(". ", *bits), F.lit("."))


def clip_context(talking, speakers, caption) -> tuple[Column, Column]:
    """What is said of a clip, in brief and at length."""
    # The sentences.
    short = F.when(talking, "A speaking portrait clip.").otherwise("A portrait clip with little or no visible speech.")
    subject = F.when(talking, "with a speaking subject").otherwise("with no strong visible vocalization")
    bits = [F.lit("A portrait-style video clip"), subject, F.format_string("and %d visible speaker(s)", speakers), F.when(col(caption) != "", F.concat(F.lit("Caption cues: "), col(caption)))]
    return short, F.concat(F.concat_ws(". ", *bits), F.lit("."))


def long_score(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How alike long items are: their scenario, their mode, half a point for each token of the event in common."""
    return shared_traits(a, b, {"scenario": 1.0, "mode": 1.0}, (tokens(a["event"]), tokens(b["event"])), 0.5)


def clip_score(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How alike clips are: speakers, talking, delivery, and a twentieth for each token of the caption in common."""
    return shared_traits(a, b, {"speakers": 1.0, "is_talking": 1.0, "delivery": 1.0}, (tokens(a["text"]), tokens(b["text"])), 0.05)


def shared_traits(a: dict[str, Column], b: dict[str, Column], points: dict[str, float], words: tuple[Column, Column], each: float) -> Column:
    """Points for every trait that both sides have alike, and ``each`` for every token in common."""
    out = F.size(F.array_intersect(*words)) * F.lit(each)
    for trait, value in points.items():
        out = out + F.when(a[trait] == b[trait], value).otherwise(0.0)
    return out


#: Noncharacters that stand for escaped backslashes and quotes while literals are told apart.
_BACKSLASH, _QUOTE = "\ufdd0", "\ufdd1"


def string_leaves(df: DataFrame, json: str) -> DataFrame:
    """(row's columns, leaf, path): the strings of a JSON text at any depth, in document order, which ``path`` tells.

    In JSON a quote that isn't escaped begins or ends a string, and a string before a colon is a member's name; so the
    others are the leaves. Text that isn't JSON has none. Of members of one name all count.
    """
    marked = F.replace(F.replace(col(json), F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    literals = F.filter(F.regexp_extract_all(marked, F.lit(r'"[^"]*"(?:\s*:)?'), 0), lambda x: F.endswith(x, F.lit('"')))
    whole = lambda x: F.replace(F.replace(x, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
    found = df.where(F.try_parse_json(json).isNotNull()).select(*df.columns, F.posexplode(literals).alias("path", "_x"))
    return found.select(*df.columns, F.from_json(F.concat(F.lit("["), whole(F.col("_x")), F.lit("]")), "array<string>")[0].alias("leaf"), "path")
