"""Token ids by a public vocabulary, one encoder a Python worker."""

import base64
import functools
import os
from collections.abc import Callable


@functools.cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """text to ids, as tokenizers gives them without special tokens added.

    path: a byte-level BPE .json file of tokenizers. Where the same vocabulary lies beside it as a .tiktoken rank file,
    that faster library makes the ids; texts that hold a special token's string go to tokenizers, which maps it to its id.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    plain = lambda text: slow.encode(text, add_special_tokens=False).ids
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return plain
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(os.path.basename(ranks), pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    return lambda text: plain(text) if any(s in text for s in special) else fast.encode_ordinary(text)
