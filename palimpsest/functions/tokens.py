"""Token counters for rendered text: any function of a text, however its counts add up.

A counter is sent to the tasks, so it is an object without open files; a tokenizer is loaded
there, once a worker.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

#: Role and content.
Message = tuple[str, str]


@dataclass(frozen=True)
class Pattern:
    """Counts the matches of a regular expression: runs of other than white space, say."""

    pattern: str = "[^ \t\n\x0b\f\r]+"

    def __call__(self, text: str) -> int:
        return len(re.findall(self.pattern, text))


@lru_cache(maxsize=8)
def _loaded(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@dataclass(frozen=True)
class TokenizerFile:
    """Counts the ids of a tokenizer's file, which lies on every node."""

    path: str

    def __call__(self, text: str) -> int:
        return len(_loaded(self.path).encode(text, add_special_tokens=False).ids)


@dataclass(frozen=True)
class ChatTemplate:
    """Messages as one text: each between start and end marks. A system message at the head is
    the prompt, what follows the history. A history that does not begin
    with the user gets `opening` as the user's turn, as templates do that want turns to
    alternate; so a longer history may count less than a shorter one."""

    start: str = "<|{role}|>"
    end: str = "<|end|>"
    opening: str = ""

    def __call__(self, messages: Sequence[Message]) -> str:
        prompt = 1 if messages and messages[0][0] == "system" else 0
        head, body = list(messages[:prompt]), list(messages[prompt:])
        extra = [("user", self.opening)] if self.opening and body and body[0][0] != "user" else []
        return "".join(self.start.format(role=role) + content + self.end for role, content in [*head, *extra, *body])


@dataclass(frozen=True)
class History:
    """Tokens that a history adds to a system prompt: of both rendered together, less those
    of the prompt alone. What follows the history is outside the count."""

    count: object
    template: object = ChatTemplate()
    system: str = ""

    def __call__(self, messages: Sequence[Message]) -> int:
        base = [("system", self.system)] if self.system else []
        return self.count(self.template([*base, *messages])) - self.count(self.template(base))


@dataclass(frozen=True)
class Lines:
    """Tokens of entries rendered one a line."""

    count: object

    def __call__(self, lines: Sequence[str]) -> int:
        return self.count("\n".join(lines))
