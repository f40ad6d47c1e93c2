"""Model backends: what turns a prompt into an answer.

A backend is a picklable object with ``generate_one(prompt, items, attempt) -> str``; it raises to signal a failed
call.  ``items`` is the list of item texts of a request (``None`` for single-row requests); a live model ignores
it, the deterministic backends below use it to answer a pack in the requested response format so the whole chain
can be checked against SQL.  ``open()`` runs once per task (e.g. to build an HTTP client).

The live provider clients are not part of this package: the container has no
network.  ``CallableBackend`` wraps any ``prompt -> text`` function a user has.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence


class Backend:
    """Base class. Subclasses override ``generate_one``."""

    #: calls that may be under way at a time in one task
    max_concurrency: int = 1
    # whether pack requests must also ship the item texts (a live model reads only the prompt)
    needs_items: bool = False
    # seconds after which a request should be ended by the backend itself (set by the runner before ``open``)
    timeout_s: float | None = None

    def open(self) -> None:  # once per task
        pass

    def generate_one(self, prompt: str, items: Sequence[str] | None, attempt: int = 0) -> str:
        raise NotImplementedError


def _md5(s: str) -> str:
    return hashlib.md5(s.encode("utf-8")).hexdigest()


def render_pack_answer(answers: Sequence[str | None], response_format: str) -> str:
    """Render per-item answers the way a well-behaved model would (None = item left out)."""
    if response_format == "indexed":
        return "\n".join(f"[{i}] {a}" for i, a in enumerate(answers, 1) if a is not None)
    if response_format == "items":
        return "\n\n".join(f"Item {i}: {a}" for i, a in enumerate(answers, 1) if a is not None)
    if response_format == "json":
        objs = [{"item_id": i, "answer": a} for i, a in enumerate(answers, 1) if a is not None]
        return json.dumps(objs, ensure_ascii=False)
    raise ValueError(f"unknown response format {response_format!r}")


class FingerprintBackend(Backend):
    """Deterministic stand-in model: the answer is the md5 of what it was asked.

    Single request -> md5(prompt) (``single_format='json'``: a fenced five-field JSON object built from it).  Pack request -> md5(item text) per item,
    rendered in ``response_format`` ('indexed', 'items' or 'json').  Items whose
    md5 starts with one of ``omit_prefixes`` are left out of the pack answer, to
    exercise missing-answer reconciliation; prompts whose md5 starts with one of
    ``fail_prefixes`` raise on the first ``fail_attempts`` calls, to exercise retry;
    prompts in ``dead_prefixes`` always fail; a pack holding an item whose md5 starts
    with one of ``poison_item_prefixes`` always fails (to exercise the row fallback); prompts
    in ``unreadable_prefixes`` are answered by an empty code block.
    """

    needs_items = True

    def __init__(self, response_format: str = "indexed", omit_prefixes: str = "", fail_prefixes: str = "",
                 fail_attempts: int = 0, fail_message: str = "HTTP 429 Too Many Requests", dead_prefixes: str = "",
                 poison_item_prefixes: str = "", single_format: str = "text", unreadable_prefixes: str = ""):
        self.response_format = response_format
        self.single_format = single_format
        self.omit_prefixes = tuple(omit_prefixes)
        self.fail_prefixes = tuple(fail_prefixes)
        self.fail_attempts = fail_attempts
        self.fail_message = fail_message
        self.dead_prefixes = tuple(dead_prefixes)
        self.poison_item_prefixes = tuple(poison_item_prefixes)
        self.unreadable_prefixes = tuple(unreadable_prefixes)

    def generate_one(self, prompt, items, attempt=0):
        key = _md5(prompt)
        if self.dead_prefixes and key.startswith(self.dead_prefixes):
            raise RuntimeError("Connection error: service unavailable")
        if items is not None and self.poison_item_prefixes and any(_md5(t).startswith(self.poison_item_prefixes) for t in items):
            raise RuntimeError("Timeout: request took too long")
        if self.fail_prefixes and key.startswith(self.fail_prefixes) and attempt < self.fail_attempts:
            raise RuntimeError(self.fail_message)
        if self.unreadable_prefixes and key.startswith(self.unreadable_prefixes):
            return "```json\n```"
        if items is None:
            if self.single_format == "json":
                # a five-field object as a model in JSON mode would answer, inside a fenced block
                obj = {"category": key[:8], "product": None, "service": key[8:16], "tag": "", "note_1": key}
                return "```json\n" + json.dumps(obj, ensure_ascii=False) + "\n```"
            return key
        answers = []
        for t in items:
            h = _md5(t)
            answers.append(None if self.omit_prefixes and h.startswith(self.omit_prefixes) else h)
        return render_pack_answer(answers, self.response_format)


class CallableBackend(Backend):
    """Wrap a user function ``prompt -> text`` (e.g. an SDK call); runs with bounded concurrency.

    With ``pass_timeout`` the function is called as ``fn(prompt, timeout=seconds)``, so that its client ends the request."""

    def __init__(self, fn: Callable[..., str], max_concurrency: int = 10, setup: Callable[[], None] | None = None, pass_timeout: bool = False):
        self.fn = fn
        self.pass_timeout = pass_timeout
        self.max_concurrency = max_concurrency
        self.setup = setup

    def open(self):
        if self.setup is not None:
            self.setup()

    def generate_one(self, prompt, items, attempt=0):
        return self.fn(prompt, timeout=self.timeout_s) if self.pass_timeout else self.fn(prompt)


class CountingBackend(Backend):
    """Wraps a backend and adds 1 to a Spark accumulator per call (single row or pack): audits paid calls."""

    def __init__(self, inner: Backend, accumulator):
        self.inner = inner
        self.acc = accumulator
        self.max_concurrency = inner.max_concurrency
        self.needs_items = inner.needs_items

    def open(self):
        self.inner.open()

    def generate_one(self, prompt, items, attempt=0):
        self.acc.add(1)
        return self.inner.generate_one(prompt, items, attempt)
