"""Server-sent events that do not end where chunks do: a small state machine puts out whole events, translated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from veilstream.streaming.state import IDLE_SECONDS, Fold, folded, folded_table

END, DONE = b"\n\n", b"data: [DONE]\n\n"
#: an event's data to the common form's; None drops the event
Translate = Callable[[bytes], bytes | None]


def push(buffer: bytes, chunk: bytes, translate: Translate) -> tuple[bytes, bytes]:
    """(whole events, translated; what is kept of an event that is not complete)"""
    *events, rest = (buffer + chunk).split(END)
    out = b""
    for event in events:
        data = b"\n".join(line.removeprefix(b"data:").strip() for line in event.split(b"\n") if line.startswith(b"data:"))
        if data and data != b"[DONE]" and (new := translate(data)) is not None:
            out += b"data: " + new + END
    return out, rest


def finish(buffer: bytes, translate: Translate) -> bytes:
    """What is left when the stream ends, and the mark of its end."""
    return (push(buffer, END, translate)[0] if buffer.strip() else b"") + DONE


def translated(chunks: DataFrame, translate: Translate) -> DataFrame:
    """Batch: chunks (stream_id, chunk_no, bytes) to stream_id, chunk_no, bytes; the last chunk also has what finishes
    the stream, and a chunk that completes no event gives no row."""
    return folded_table(chunks, _Events(translate))


class _Events(Fold):
    state, output = "buffer binary, no long", "chunk_no long, bytes binary"

    def __init__(self, translate: Translate):
        self.translate = translate

    def begin(self) -> tuple:
        return b"", -1

    def step(self, state, chunk_no, chunk, last):
        piece, buffer = push(bytes(state[0]), chunk, self.translate)
        if last:
            piece, buffer = piece + finish(buffer, self.translate), b""
        return ([(chunk_no, piece)] if piece else []), (buffer, chunk_no)

    def broken_off(self, state):
        return [(state[1] + 1, finish(bytes(state[0]), self.translate))]


def translated_stream(chunks: DataFrame, translate: Translate, idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """Streaming: chunks (stream_id, chunk_no, bytes, last); the state is the event that is not complete.  A stream
    without chunks for so many seconds has broken off: it is finished as it is, and its state ends."""
    return folded(chunks, _Events(translate), idle_seconds)
