"""3-mer vocabulary, token encoding and masking as column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, functions as F

from strandwise.functions.keys import as_col, let

# Ids of the special tokens, then all 3-mers in alphabetical order.
SPECIALS = ("<pad>", "<unk>", "<eos>", "<sos>", "<mask>")
PAD, UNK, EOS, SOS, MASK = range(5)
VOCABULARY = SPECIALS + tuple("".join(t) for t in product("ACGT", repeat=3))
NO_CALL = 2
IGNORED = -100


def token_ids(dna: Column) -> Column:
    """Ids of a space-joined 3-mer sequence; unknown tokens become 1."""
    letter = lambda t, at: F.instr(F.lit("ACGT"), F.substring(t, at, 1)) - 1
    return F.transform(
        F.split(dna, " "),
        lambda t: F.when(
            t.rlike("^[ACGT]{3}$"), (len(SPECIALS) + letter(t, 1) * 16 + letter(t, 2) * 4 + letter(t, 3)).cast("int")
        ).otherwise(F.lit(UNK)),
    )


def methyl_states(methyl: Column) -> Column:
    """Methylation string as an array of small integers."""
    return F.transform(F.split(methyl, ""), lambda c: c.cast("tinyint"))


def encode(dna: Column, methyl: Column, max_len: int) -> tuple[Column, Column]:
    """Fixed-length ids and states of ``max_len + 1`` entries.

    Cut or padded to ``max_len``; the end marker replaces the first pad, or the last token when
    there is no pad; the start marker goes in front. Markers and pads carry state 2.
    """
    blank = F.lit(NO_CALL).cast("tinyint")
    full_ids = let(
        F.slice(token_ids(dna), 1, max_len - 1),
        lambda ids: F.concat(
            F.array(F.lit(SOS)), ids, F.array(F.lit(EOS)), F.array_repeat(F.lit(PAD), F.lit(max_len - 1) - F.size(ids))
        ),
    )
    full_states = let(
        F.slice(methyl_states(methyl), 1, max_len - 1),
        lambda states: F.concat(F.array(blank), states, F.array_repeat(blank, F.lit(max_len) - F.size(states))),
    )
    return full_ids, full_states


def decode(ids: Column) -> Column:
    """Token ids back to bases: specials dropped, first base, all middle bases, last base."""
    kept = F.filter(ids, lambda i: i >= len(SPECIALS))
    text = "".join(VOCABULARY[len(SPECIALS) :])
    base = lambda i, at: F.substring(F.lit(text), (i - len(SPECIALS)) * 3 + at, F.lit(1))
    middles = lambda k: F.array_join(F.transform(k, lambda i: base(i, 2)), "")
    return let(
        kept,
        lambda k: F.when(
            F.size(k) > 0, F.concat(base(F.element_at(k, 1), 1), middles(k), base(F.element_at(k, -1), 3))
        ),
    )


def draw(*parts: Column | str) -> Column:
    """Reproducible uniform number in [0, 1) from the given values."""
    text = F.md5(F.concat_ws("|", *[as_col(p).cast("string") for p in parts]))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("double") / float(1 << 32)


def mask_tokens(ids: Column, row_key: Column, rate: float = 0.15, k: int = 3, seed: int = 42) -> Column:
    """Masked copy of a padded id array, as struct(inputs, labels, centres).

    Centres are drawn among non-special tokens and widened by k // 2 neighbours up to the last
    non-special token. Of the masked places 80% show the mask id, 10% a random id, 10% stay. Labels
    outside the masked places are -100. The last non-special token shows the end marker and a start
    marker goes in front. One digest per place gives its three draws.
    """
    half = k // 2
    reach = [d for d in range(-half, half + 1) if d != 0]
    if k % 2 == 0:
        reach = reach[:-1]
    drawn = lambda text, part: F.conv(F.substring(text, 8 * part + 1, 8), 16, 10).cast("double") / float(1 << 32)
    real = lambda t: t >= len(SPECIALS)

    def built(tokens: Column, draws: Column, end: Column, centres: Column, hidden: Column) -> Column:
        def shown(token: Column, p: Column) -> Column:
            text = F.get(draws, p)
            random_id = F.floor(drawn(text, 2) * len(VOCABULARY)).cast("int")
            replaced = let(drawn(text, 1), lambda x: F.when(x < 0.8, F.lit(MASK)).when(x < 0.9, random_id).otherwise(token))
            return F.when(p == end, F.lit(EOS)).when(F.get(hidden, p), replaced).otherwise(token)

        labels = F.transform(tokens, lambda t, p: F.when(F.get(hidden, p), t).otherwise(F.lit(IGNORED)))
        return F.struct(
            F.concat(F.array(F.lit(SOS)), F.transform(tokens, shown)).alias("inputs"),
            F.concat(F.array(F.lit(IGNORED)), labels).alias("labels"),
            F.concat(F.array(F.lit(False)), centres).alias("centres"),
        )

    def placed(tokens: Column, draws: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(tokens, lambda t, p: F.when(real(t), p))), F.lit(-1))
        chosen = F.transform(tokens, lambda t, p: real(t) & (drawn(F.get(draws, p), 0) < rate))

        def near(centres: Column, end: Column) -> Column:
            beside = lambda p: [F.coalesce(F.get(centres, p - d), F.lit(False)) for d in reach]
            return F.transform(centres, lambda c, p: F.when(p <= end, F.array_contains(F.array(c, *beside(p)), True)).otherwise(c))

        return let(last, lambda end: let(chosen, lambda c: let(near(c, end), lambda hidden: built(tokens, draws, end, c, hidden))))

    digests = lambda tokens: F.transform(tokens, lambda t, p: F.md5(F.concat_ws("|", row_key.cast("string"), p.cast("string"), F.lit(str(seed)))))
    return let(ids, lambda tokens: let(digests(tokens), lambda draws: placed(tokens, draws)))


def crop_random(ids: Column, row_key: Column, seq_len: int, shortest: int = 5, seed: int = 42) -> Column:
    """With probability one half cut the array to a length drawn from ``shortest..seq_len``."""
    length = shortest + F.floor(
        draw(row_key, F.lit("length"), F.lit(str(seed))) * (seq_len - shortest + 1)
    ).cast("int")
    return F.when(
        draw(row_key, F.lit("crop"), F.lit(str(seed))) < 0.5, F.slice(ids, F.lit(1), length)
    ).otherwise(ids)
