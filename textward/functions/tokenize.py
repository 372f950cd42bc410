"""A small tokenizer for models: words, characters or word pieces, with a vocabulary that follows from fixed word lists.

A merge joins two plain letters, and only a word's first part is plain, so at most one merge happens, at the word's start; word
pieces are therefore an expression without a loop.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: special ids, and the sources of the vocabulary in order; a later entry takes the word's id
PAD, UNK, CLS, SEP, MASK = 0, 1, 2, 3, 4
FIRST = 5
PUNCTUATION = ".,!?;:'-\"()[]{}/<>@#$%^&*+=_\\|`~"
COMMON = (
    "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she "
    "or an will my one all would there their what so up out if about who get which go me when make can like time no just him know take "
    "people into year your good some could them see other than then now look only come its over think also"
).split()
SECURITY = (
    "ignore forget disregard override bypass skip delete remove jailbreak dan sudo admin root privileged elevated "
    "pretend roleplay act persona character simulate imagine behave respond answer reply talk speak write "
    "system prompt instruction instructions previous above below original initial real actual true hidden secret "
    "execute run eval print output display show reveal tell repeat generate create produce give provide "
    "context conversation message messages history chat session beginning start end first last new updated "
    "api key token password credential access permission code script function variable data json xml "
    "you are now from on must should always never everything anything nothing all any every"
).split()
PIECES = (
    "##ing ##ed ##er ##est ##ly ##tion ##ness ##ment ##able ##ible ##ful ##less ##ive ##ous "
    "un## re## pre## dis## mis## over## under## ##s ##es ##al ##ity ##ize ##ise ##ify"
).split()
MERGES = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur "
    "ig no re by pa ss sy st em pr om pt in st ru ct io ns ad mi ro ot ja il br ea ck ex ec ut"
).split()


def vocabulary() -> dict[str, int]:
    """Word to id, without the special tokens' offset."""
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)] + [str(d) for d in range(10)]
    return {w: k for k, w in enumerate([*letters, *PUNCTUATION, *COMMON, *SECURITY, *PIECES])}


def normalized(text: Column) -> Column:
    """White space collapsed, other than letters, numbers, punctuation and symbols dropped, lower case, trimmed."""
    one = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.trim(F.lower(F.regexp_replace(one, r"[^\p{L}\p{N}\p{P}\p{S} ]", "")))


def words(text: Column) -> Column:
    """Words of the normalized text; each punctuation mark or symbol is one of its own."""
    return F.regexp_extract_all(normalized(text), F.lit(r"([\p{P}\p{S}]|[^\s\p{P}\p{S}]+)"), 1)


def pieces(word: Column) -> Column:
    """A word's pieces: its first two letters where they merge, or the first, then ## and each further letter."""
    head = F.when(F.left(word, F.lit(2)).isin(sorted(set(MERGES))), 2).otherwise(1)
    rest = F.filter(F.split(F.substr(word, head + 1), ""), lambda c: c != "")
    return F.concat(F.array(F.left(word, head)), F.transform(rest, lambda c: F.concat(F.lit("##"), c)))


def _ids(tokens: Column, length: int) -> Column:
    table = F.create_map(*[F.lit(x) for w, k in vocabulary().items() for x in (w, k + FIRST)])
    # a text that is too long still ends with SEP, as in the reference
    looked = F.transform(F.slice(tokens, 1, max(0, length - 2)), lambda w: F.coalesce(F.try_element_at(table, w), F.lit(UNK)))
    return F.slice(F.concat(F.array(F.lit(CLS)), looked, F.array(F.lit(SEP)), F.array_repeat(F.lit(PAD), length)), 1, length)


def word_ids(text: Column, length: int = 512) -> Column:
    return _ids(words(text), length)


def char_ids(text: Column, length: int = 512) -> Column:
    return _ids(F.filter(F.split(normalized(text), ""), lambda c: c != ""), length)


def subword_ids(text: Column, length: int = 512) -> Column:
    return _ids(F.flatten(F.transform(words(text), pieces)), length)


def attention_mask(ids: Column) -> Column:
    return F.transform(ids, lambda i: (i != PAD).cast("int"))


def decode(ids: Column) -> Column:
    """Tokens of ids, without padding, joined by spaces."""
    names = {v + FIRST: k for k, v in vocabulary().items()} | {UNK: "[UNK]", CLS: "[CLS]", SEP: "[SEP]", MASK: "[MASK]"}
    table = F.create_map(*[F.lit(x) for k, w in sorted(names.items()) for x in (k, w)])
    return F.array_join(F.transform(F.filter(ids, lambda i: i != PAD), lambda i: F.coalesce(F.try_element_at(table, i), F.lit("[UNK]"))), " ")
