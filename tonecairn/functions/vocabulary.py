"""What names say: the instrument of a drum hit or folder, and the tags of a preset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import labels as L

# Categories of hits in the order of a kit.
KIT_ORDER = """kick snare hat_closed hat_open clap snap rim cowbell claves maracas tambourine shaker triangle block guiro bell cymbal_crash cymbal_ride
tom_low tom_mid tom_high conga_low conga_mid conga_high other""".split()
# Words that name a category, in the order in which they are tried.
DIRECT = {
    "BASSDRUM": "kick", "BD": "kick", "KICK": "kick", "KCK": "kick", "SNAREDRUM": "snare", "SD": "snare", "SNARE": "snare", "SNR": "snare", "SNAR": "snare",
    "HANDCLAP": "clap", "CLAP": "clap", "SNAP": "snap", "RIMSHOT": "rim", "RIM": "rim", "COWBELL": "cowbell", "COWB": "cowbell", "CLAVES": "claves",
    "CLAVE": "claves", "CLAV": "claves", "MARACA": "maracas", "MARACAS": "maracas", "TAMBOURINE": "tambourine", "TAMB": "tambourine", "SHAKER": "shaker",
    "CABASA": "shaker", "TRIANGLE": "triangle", "TRIA": "triangle", "WOODBLOCK": "block", "BLOCK": "block", "GUIRO": "guiro", "BELL": "bell",
    "CRASH": "cymbal_crash", "CRAS": "cymbal_crash", "CHINA": "cymbal_crash", "SPLASH": "cymbal_crash", "RIDE": "cymbal_ride",
}
# Words of families whose member a modifier tells.
HATS, TOMS = "CH OH HH HAT HIHAT HATS HIHATS".split(), "TOM TOML TOMM TOMH".split()
CONGAS, CYMBALS = "CONGA CONGAS CONL CONM CONH BONGO BONGOS".split(), "CYM CYMBAL".split()
LOW, HIGH, OPEN = "LOW LO".split(), "HIGH HI".split(), "OPEN OH".split()
# Words that stand for each tag, the theme words that a name overrules, the most tags of a preset and the tag of none.
TAG_WORDS = {
    "Bass": "bass basses bassics sub subbass",
    "Lead": "lead leads leaders",
    "Pad": "pad pads fillers",
    "Keys": "key keys keyboard keyboards piano pianos rhodes wurlitzer wurli clav clavinet chord chords mallet pianoids bell bells harpsichord celeste",
    "Organ": "organ organs orgones farfisa hammond leslie",
    "Strings": "string strings violin violins cello cellos viola pizzicato pizz",
    "Orchestral": "orchestral orchestra brass horn horns trumpet trumpets trombone trombones tuba woodwind woodwinds flute flutes clarinet clarinets oboe bassoon bassoons ensemble timpani marcato staccato",
    "Vocal": "vocal vocals vox voice voices choir chant chants female male",
    "Guitar": "guitar guitars gtr",
    "Percussion": "perc percs percussion perkers conga congas bongo bongos shaker tambourine cowbell claves maracas",
    "Drum": "drum drums drumkit kit kits kick snare hat hats clap cymbal cymbals tom toms break breakbeat",
    "SFX": "fx sfx effect effects riser sweep impact noise scatter glitch",
    "Atmosphere": "atmos atmosphere atmospheric ambient ambience drone texture textures evolving calm distant dream dreams dreamy",
    "Foley": "foley field found",
    "Synth": "synth synths synthesizer poly polysynth mono analog analogue digital arp saw square pulse pwm acid rhythmic template templates",
}
THEMES, MOST_TAGS, NO_TAG = "dream dreams dreamy".split(), 3, "Synth"


def drum_category(name: Column) -> Column:
    """The first direct word decides, then hats, toms and congas with their modifiers, then plain cymbals; a number at a word's end may be left off."""
    words = F.regexp_extract_all(F.upper(name), F.lit("[A-Z0-9#]+"), 0)
    all_ = F.array_union(words, F.transform(words, lambda w: F.regexp_replace(w, "[0-9]+$", "")))
    has = lambda some: F.arrays_overlap(all_, F.array(*(F.lit(x) for x in some)))
    direct = list(DIRECT.items())
    place = F.array_min(F.transform(F.array_intersect(F.array(*(F.lit(w) for w, _ in direct)), all_), lambda w: F.array_position(F.array(*(F.lit(x) for x, _ in direct)), w)))
    of = lambda family: F.when(has(LOW), f"{family}_low").when(has(HIGH), f"{family}_high").otherwise(f"{family}_mid")
    return (
        F.when(F.concat_ws(" ", words).rlike(r"(^| )BASS DRUM"), "kick")
        .when(place.isNotNull(), F.element_at(F.array(*(F.lit(c) for _, c in direct)), place.cast("int")))
        .when(has(HATS), F.when(has(OPEN), "hat_open").otherwise("hat_closed"))
        .when(has(TOMS), of("tom")).when(has(CONGAS), of("conga")).when(has(CYMBALS), "cymbal_crash").otherwise("other")
    )


def folder_category(name: Column) -> Column:
    """The category of a folder's name, without its number and with its words as one."""
    return drum_category(F.regexp_replace(F.regexp_replace(name, r"^\d+\.\s*", ""), "[^A-Za-z0-9#]", ""))


def kit_rank(category: Column) -> Column:
    return F.array_position(F.array(*(F.lit(c) for c in KIT_ORDER)), category) - 1


def _tag_of() -> Column:
    return F.create_map(*(F.lit(x) for tag, words in TAG_WORDS.items() for w in words.split() for x in (w, tag)))


def _named(text: Column) -> Column:
    """(tag, whether a theme word gave it) of the words of a text that stand for a tag, in order."""
    words = F.transform(L.tokens(text), lambda w: F.struct(F.try_element_at(_tag_of(), w).alias("tag"), w.isin(*THEMES).alias("theme")))
    return F.filter(words, lambda x: x["tag"].isNotNull())


def said_by_tags(label: Column) -> Column:
    """Whether every word of a label stands for a tag."""
    words = L.tokens(label)
    return (F.size(words) > 0) & F.forall(words, lambda w: F.try_element_at(_tag_of(), w).isNotNull())


def preset_tags(drums: Column, labels: Column, name: Column) -> Column:
    """Up to three tags: of the labels (an array, the deepest first), then of the name; a theme word of a label counts only where the name has no tag.

    A kit is a Drum, and Percussion if any word says so.
    """
    of_labels, own = F.flatten(F.transform(labels, _named)), _named(name)
    counted = F.concat(F.filter(of_labels, lambda x: ~(x["theme"] & (F.size(own) > 0))), own)
    tags = F.slice(F.array_distinct(F.transform(counted, lambda x: x["tag"])), 1, MOST_TAGS)
    percussion = F.exists(F.concat(of_labels, own), lambda x: x["tag"] == "Percussion")
    kit = F.when(percussion, F.array(F.lit("Drum"), F.lit("Percussion"))).otherwise(F.array(F.lit("Drum")))
    return F.when(drums, kit).when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(NO_TAG)))
