"""Vocabulary files of public tokenizers, and ids of words kept between batches.

The files are found by the installed package ``public_tokenizers``, or in the folder a
caller names; they are opened by each Python worker and never copied.
"""

from __future__ import annotations

import os

#: Pieces of text whose encoding a worker keeps; beyond it starts anew. Longer ones are
#: encoded each time. Neither changes a result.
KEPT, KEPT_LETTERS = 800_000, 64

#: Ends a piece handed to the byte-pair encoder; no safe text holds it.
STOP = "\x01"

#: Letters and numbers below U+0250, and the contractions that the
#: vocabulary's pattern splits off.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

#: Fixed value: the pattern by which the byte-level vocabulary splits text before merging.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a vocabulary file in ``folder``, by default that of the installed package."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def open_tokenizer(path: str, plain_specials: bool = False):
    """A tokenizer of the ``tokenizers`` library, one thread. ``plain_specials``: the
    strings of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = plain_specials
    return tok


def byte_letters() -> dict:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1
    bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds:
    """Ids of texts by a lower-casing vocabulary with word ends (``tokenizers`` file), as
    little-endian 32-bit bytes.

    The vocabulary drops white space, so the ids of a text are those of its words one
    after another. Distinct words are kept. Those of letters below U+0250 are split into
    letters, numbers and signs here, and all new ones encoded together by the same merges,
    each piece closed by ``STOP`` in place of the word end; a word with other letters, or
    one that may name a special token, goes through the tokenizer itself."""

    def __init__(self, path: str):
        import json
        import re

        import numpy as np
        import tiktoken
        self.whole = open_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        to_byte, ranks = byte_letters(), {}
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            closed = token.endswith("</w>")
            core = token[:-4] if closed else token
            if core.startswith("<|"):
                continue
            ranks[bytes(to_byte[c] for c in core) + STOP.encode() * closed] = i
            self.closes[i] = closed
        self.encoder = tiktoken.Encoding("words", pat_str=f"[^{STOP}\\n]*{STOP}|\\n",
                                         mergeable_ranks=ranks, special_tokens={})
        self.line = ranks[b"\n"]
        self.unsafe = re.compile("[^!-~¡-ɏ\\n]|<\\|")
        self.pieces = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|{CONTRACTIONS}|[^{LETTERS}{NUMBERS}\\n]+")
        self.known: dict = {"": b""}

    def learn(self, words: list) -> None:
        """Make the ids of these distinct words known."""
        import numpy as np
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known = {"": b""}
            new = [w for w in words if w]
        other = [w for w in new if self.unsafe.search(w)] if self.unsafe.search("\n".join(new)) else []
        for w, e in zip(other, self.whole.encode_batch(other, add_special_tokens=False)):
            self.known[w] = np.array(e.ids, dtype="<u4").tobytes()
        odd = set(other)
        plain = [w for w in new if w not in odd] if odd else new
        if plain:
            lines = self.pieces.sub(f"\\g<0>{STOP}", "\n".join(plain).lower()) + "\n"
            ids = np.array(self.encoder.encode_ordinary(lines), dtype="<u4")
            ends = np.flatnonzero(ids == self.line) * 4
            raw = ids.tobytes()
            self.known.update(zip(plain, (raw[a:b] for a, b in zip(
                [0, *(ends + 4).tolist()], ends.tolist()))))

    def of(self, texts: list) -> tuple:
        """Ids of all texts one after another (an array), and where each text's begin."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        col = pa.array([t.lower() if t.isascii() and "<|" not in t else t for t in texts],
                       pa.large_string())
        for c in "\n\r\t":
            col = pc.replace_substring(col, c, " ")
        split = pc.split_pattern(col, " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(distinct)
        raw = [self.known[w] for w in distinct]
        for w in distinct:
            if len(w) > KEPT_LETTERS:
                del self.known[w]
        ids = np.frombuffer(b"".join(raw), "<u4")
        size = np.fromiter(map(len, raw), np.int32, len(raw)) // 4
        at = words.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n, dtype=np.int64)
        shift = (np.cumsum(size, dtype=np.int32) - size)[at] - (ends - n).astype(np.int32)
        taken = np.repeat(shift, n)
        taken += np.arange(len(taken), dtype=np.int32)
        return ids[taken], np.concatenate([[0], ends])[np.asarray(split.offsets)]
