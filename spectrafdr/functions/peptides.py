"""Peptide strings and tokens as column expressions.

Everything here is built-in Spark SQL, so it stays inside the JVM next to the
scan; nothing ships a row to Python.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from spectrafdr.constants import RESIDUE_MASSES, TOKEN_PATTERN



def usable_label(value: Column, is_array: bool) -> Column:
    """TRUE when a label cell holds a non-blank string or a non-empty list."""
    present = F.size(value) > 0 if is_array else F.trim(value) != ""
    return F.coalesce(present, F.lit(False))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_tokens(tokens: Column) -> Column:
    """Empty token lists become NULL."""
    return bound(tokens, lambda t: F.when(F.size(t) > 0, t))


def has_tokens(tokens: Column) -> Column:
    return F.coalesce(F.size(tokens) > 0, F.lit(False))


def literal_map(entries: Mapping[str, object]) -> Column:
    """Constant map column, parsed in one call and folded to a literal by Catalyst."""

    def cell(value: object) -> str:
        if isinstance(value, float):
            return f"{value!r}D"
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    return F.expr("map(" + ", ".join(f"{cell(k)}, {cell(v)}" for k, v in entries.items()) + ")")


def tokenise(text: Column) -> Column:
    """Split a peptide string into residue / modification tokens.

    Bare residues, the common case, need no match of the whole grammar at every letter.
    """
    tokens = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    return F.when(text.rlike(r"\A[A-Z]+\z"), F.split(text, "")).otherwise(tokens)


def leucine_to_isoleucine(tokens: Column) -> Column:
    """Whole-token rewrite, so that names such as ``[Acetyl]`` keep their letters."""
    return F.transform(tokens, lambda t: F.when(t == "L", F.lit("I")).otherwise(t))


def remap_tokens(tokens: Column, remapping: Mapping[str, str] | None) -> Column:
    if not remapping:
        return tokens
    table = literal_map(remapping)
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))


def normalise_tokens(
    tokens: Column,
    remapping: Mapping[str, str] | None = None,
    normalise_leucine: bool = True,
) -> Column:
    """L->I on tokens, notation remapping, empty -> NULL."""
    if normalise_leucine:
        tokens = leucine_to_isoleucine(tokens)
    return clean_tokens(remap_tokens(tokens, remapping))


def normalise_peptide(
    cell: Column,
    is_array: bool,
    remapping: Mapping[str, str] | None = None,
    normalise_leucine: bool = True,
) -> Column:
    """A raw string or a token list to canonical tokens, or NULL if there are none."""
    tokens = cell if is_array else F.when(F.trim(cell) != "", tokenise(cell))
    return normalise_tokens(tokens, remapping, normalise_leucine)


def proforma(tokens: Column) -> Column:
    """Join tokens; a hyphen follows a leading and precedes a trailing modification.

    A terminal modification is a token that does not start with a letter, and it
    is only split off while at least one more token remains.
    """
    n = F.size(tokens)
    standalone = r"^[^\p{L}]"
    lead = (n > 1) & F.get(tokens, F.lit(0)).rlike(standalone)
    after_lead = n - lead.cast("int")
    trail = (after_lead > 1) & F.get(tokens, n - 1).rlike(standalone)
    body = F.array_join(
        F.slice(tokens, lead.cast("int") + 1, after_lead - trail.cast("int")), ""
    )
    text = F.concat(
        F.when(lead, F.concat(F.get(tokens, F.lit(0)), F.lit("-"))).otherwise(""),
        body,
        F.when(trail, F.concat(F.lit("-"), F.get(tokens, n - 1))).otherwise(""),
    )
    return F.when(n > 0, text).otherwise("")


def stripped_for_match(text: Column) -> Column:
    """Drop modifications, then I->L, for proteome substring matching."""
    bare = F.regexp_replace(text, r"\([^)]*\)-?", "")
    bare = F.regexp_replace(bare, r"\[[^\]]*\]-?", "")
    bare = F.regexp_replace(bare, r"[+-]?\d+(?:\.\d+)?-?", "")
    return F.coalesce(F.translate(bare, "I", "L"), F.lit(""))


def match_string(tokens: Column, raw: Column | None = None) -> Column:
    """The raw prediction if it is not blank, else the joined tokens; stripped."""
    source = proforma(tokens)
    if raw is not None:
        source = F.when(F.coalesce(F.trim(raw) != "", F.lit(False)), raw).otherwise(source)
    return stripped_for_match(source)


def residue_count(cell: Column, is_array: bool) -> Column:
    """Number of tokens (not characters); NULL and blanks count as 0."""
    tokens = cell if is_array else tokenise(F.trim(cell))
    return F.coalesce(F.greatest(F.size(tokens), F.lit(0)), F.lit(0))


def residue_mass(token: Column, masses: Mapping[str, float] | None = None) -> Column:
    """Mass of one token; an unknown token raises instead of giving a wrong sum."""
    table = literal_map(dict(masses or RESIDUE_MASSES))
    return F.coalesce(
        F.try_element_at(table, token),
        F.raise_error(F.concat(F.lit("unknown residue token: "), token)).cast("double"),
    )


def residue_mass_list(tokens: Column, masses: Mapping[str, float] | None = None) -> Column:
    return F.transform(tokens, lambda t: residue_mass(t, masses))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def residue_matches(
    sequence: Column,
    prediction: Column,
    masses: Mapping[str, float] | None = None,
    residue_tolerance: float = 0.1,
    prefix_tolerance: float = 0.5,
) -> Column:
    """Amino-acid matches of a de novo peptide against its label.

    Published rule (Ma 2015; Tran et al., PNAS 2017): walk both peptides by prefix
    mass; positions whose prefix masses agree within ``prefix_tolerance`` are
    compared, and count when the residue masses agree within
    ``residue_tolerance``; otherwise the side with the smaller prefix advances.
    One fold over at most ``len(a) + len(b)`` steps, inside the JVM.
    """
    a = residue_mass_list(sequence, masses)
    b = residue_mass_list(prediction, masses)

    def at(values: Column, index: Column) -> Column:
        return F.coalesce(F.get(values, index), F.lit(0.0))

    def state(i, j, prefix_a, prefix_b, hits) -> Column:
        return F.struct(
            i.alias("i"), j.alias("j"), prefix_a.alias("pa"), prefix_b.alias("pb"), hits.alias("hits")
        )

    def fold(both: Column) -> Column:
        ma, mb = both["a"], both["b"]

        def step(s: Column, _: Column) -> Column:
            done = (s["i"] >= F.size(ma)) | (s["j"] >= F.size(mb))
            aligned = F.abs(s["pa"] - s["pb"]) < prefix_tolerance
            same = F.abs(at(ma, s["i"]) - at(mb, s["j"])) < residue_tolerance
            move_a = (aligned | (s["pa"] < s["pb"])).cast("int")
            move_b = (aligned | (s["pa"] >= s["pb"])).cast("int")
            moved = state(
                s["i"] + move_a,
                s["j"] + move_b,
                s["pa"] + F.when(move_a == 1, at(ma, s["i"] + 1)).otherwise(0.0),
                s["pb"] + F.when(move_b == 1, at(mb, s["j"] + 1)).otherwise(0.0),
                s["hits"] + (aligned & same).cast("int"),
            )
            return F.when(done, s).otherwise(moved)

        start = state(F.lit(0), F.lit(0), at(ma, F.lit(0)), at(mb, F.lit(0)), F.lit(0))
        steps = F.sequence(F.lit(1), F.size(ma) + F.size(mb))
        return F.aggregate(steps, start, step, lambda s: s["hits"])

    both = F.coalesce((F.size(sequence) > 0) & (F.size(prediction) > 0), F.lit(False))
    return (
        F.when(~both, F.lit(0))
        .when(sequence == prediction, F.size(sequence))  # the common case needs no walk
        .otherwise(bound(F.struct(a.alias("a"), b.alias("b")), fold))
    )


def is_correct(num_matches: Column, sequence: Column, prediction: Column, valid: Column) -> Column:
    """Full-length match on both sides."""
    full = (num_matches == F.size(sequence)) & (num_matches == F.size(prediction))
    return F.coalesce(valid & full, F.lit(False))


def token_edit_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance over tokens divided by the longer length.

    Unmodified peptides have one-letter tokens, so the built-in string
    ``levenshtein`` applies to the joined letters. Otherwise each distinct token of
    the pair is first encoded as one private-use character.
    """
    plain = (F.length(F.array_join(left, "")) == F.size(left)) & (
        F.length(F.array_join(right, "")) == F.size(right)
    )
    alphabet = F.array_distinct(F.concat(left, right))

    def encode(tokens: Column) -> Column:
        return F.array_join(
            F.transform(
                tokens,
                lambda t: F.decode(
                    F.unhex(F.hex(F.array_position(alphabet, t) + 0xE000)), "UTF-16BE"
                ),
            ),
            "",
        )

    longest = F.greatest(F.size(left), F.size(right))
    distance = F.when(
        plain, F.levenshtein(F.array_join(left, ""), F.array_join(right, ""))
    ).otherwise(F.levenshtein(encode(left), encode(right)))
    return F.when(longest == 0, F.lit(0.0)).otherwise(distance / longest)


def misplaced_terminal_mod(text: Column, mods: tuple[str, ...]) -> Column:
    """TRUE when one of ``mods`` occurs anywhere after position 0 of the raw string."""
    found = F.lit(False)
    for mod in mods:
        first = F.instr(text, mod)
        again = F.locate(mod, text, len(mod) + 1)
        found = found | (first > 1) | ((first == 1) & (again > 0))
    return F.coalesce(found, F.lit(False))


def spectrum_index(reference: Column) -> Column:
    """``ms_run[1]:index=12`` -> 12, NULL when it cannot be parsed."""
    digits = F.regexp_extract(reference, r"index=(\d+)", 1)
    return F.when(digits != "", digits.cast("long"))
