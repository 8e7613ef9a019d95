"""Tokenizers by path, shipped to the executors as bytes."""

from __future__ import annotations

import base64
import hashlib
import json
import os

#: Fixed value: the pattern that splits text before the merges of byte-level rank files.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or one from 256 on in byte order."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


def _as_ranks(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ranks and special tokens of a plain byte-level BPE description, or None if it is anything else.

    Ranks give the same ids as the merges exactly if merge number i makes the token 256 + i and each added token is
    special and matched as it stands.
    """
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    plain = plain and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = plain and not any(spec.get(k) for k in ("normalizer", "truncation", "padding", "post_processor"))
    added = spec.get("added_tokens") or []
    if not plain or any(not t["special"] or t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        return None
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if len(vocab) != 256 + len(pairs) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    byte_of = _byte_of_char()
    return {bytes(byte_of[c] for c in k): i for k, i in vocab.items()}, {t["content"]: t["id"] for t in added}


class TokenizerFile:
    """A tokenizer's file, read on the driver.

    ``.json`` is for tokenizers, ``.model`` for sentencepiece, ``.tiktoken`` for tiktoken. No begin, end or added
    special tokens; strings of special tokens inside texts are handled as the library does by default. Byte-level BPE
    descriptions whose merges are their ids run on tiktoken's faster code, which gives the same ids.
    """

    def __init__(self, path: str, pattern: str = BYTE_LEVEL_PATTERN, specials: bool = True):
        """specials: whether strings of special tokens inside texts become those tokens, as by default, or plain text."""
        with open(path, "rb") as f:
            self.data = f.read()
        self.kind, self.pattern, self.specials = os.path.splitext(path)[1].lstrip("."), pattern, specials
        #: Names the tokenizer in caches: file, kind and options.
        self.version = hashlib.sha256(b"\0".join((self.data, self.kind.encode(), pattern.encode(), b"1", *([] if specials else [b"plain"])))).hexdigest()

    def ship(self, spark):
        return spark.sparkContext.broadcast((self.version, self.kind, self.pattern, self.data, self.specials))


_LOADED: dict[str, object] = {}


def encoder(shipped):
    """On an executor: a function from a text to its ids as a uint32 array; built once per process."""
    version, kind, pattern, data, specials = shipped.value
    if version not in _LOADED:
        _LOADED[version] = _build(kind, pattern, data, specials)
    return _LOADED[version]


def token_bytes(shipped) -> list[bytes]:
    """On an executor: the bytes that each id stands for, empty for special tokens.

    Byte-level entries are decoded; a piece of sentencepiece is its UTF-8 with U+2581 as a space, a byte piece that byte.
    Other vocabularies have no fixed bytes for an id: ValueError.
    """
    _, kind, _, data, _ = shipped.value
    if kind == "model":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        byte = lambda piece: bytes([int(piece[3:5], 16)])
        piece = lambda i: sp.id_to_piece(i).replace("\u2581", " ").encode()
        return [b"" if sp.is_control(i) or sp.is_unknown(i) else byte(sp.id_to_piece(i)) if sp.is_byte(i) else piece(i) for i in range(sp.get_piece_size())]
    if kind == "tiktoken":
        ranks, special = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}, {}
    elif kind == "json" and (found := _as_ranks(json.loads(data))):
        ranks, special = found
    else:
        raise ValueError(f"ids of this .{kind} file have no bytes of their own")
    out = [b""] * (1 + max([*ranks.values(), *special.values()]))
    for token, i in ranks.items():
        out[i] = token
    return out


def _build(kind: str, pattern: str, data: bytes, specials: bool = True):
    import numpy as np

    if kind == "model":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda text: np.asarray(sp.encode(text), dtype=np.uint32)
    if kind == "json":
        found = _as_ranks(json.loads(data))
        if found is None:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_str(data.decode())
            tok.no_truncation()
            tok.no_padding()
            tok.encode_special_tokens = not specials
            return lambda text: np.asarray(tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        ranks, special = found
    elif kind == "tiktoken":
        ranks, special = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}, {}
    else:
        raise ValueError(f"no tokenizer library for .{kind} files")
    import tiktoken

    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special) if specials else set()
    return lambda text: enc.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
