"""Tensors of a person detector: input layout, letterbox and the decoding of its output (P26, P27, A10). Array code only; a session is the caller's."""

from __future__ import annotations

import numpy as np

#: Value of the border, side of a dynamic input, and places of objectness and person class in a row of attributes. Fixed values.
FILL, DYNAMIC, FIRST, SECOND = np.float32(114.0) / np.float32(255.0), 640, 4, 5


def input_layout(shape: list[int] | tuple[int, ...]) -> tuple[bool, int, int]:
    """Whether channels come first, and height and width, of a model's input shape; a side that isn't above 0 is dynamic."""
    if len(shape) != 4 or 3 not in (shape[1], shape[3]):
        raise ValueError(f"not an image input: {list(shape)}")
    first = shape[1] == 3
    h, w = (shape[2], shape[3]) if first else (shape[1], shape[2])
    return first, h if h > 0 else DYNAMIC, w if w > 0 else DYNAMIC


def letterbox(frame: np.ndarray, height: int, width: int, channels_first: bool = True) -> np.ndarray:
    """``frame(h, w, 3)`` in BGR as an RGB tensor from 0 to 1, scaled to fit, the border filled evenly.

    Two index vectors say which source row and column each target one shows;
    one gather takes all pixels.
    """
    h, w = frame.shape[:2]
    scale = min(np.float32(width) / np.float32(max(w, 1)), np.float32(height) / np.float32(max(h, 1)))
    side = lambda n: max(int(np.floor(np.float32(n) * scale + np.float32(0.5))), 1)
    tall, wide = side(h), side(w)
    at = lambda n, of: np.minimum(np.floor(np.arange(n, dtype=np.float32) / scale).astype(np.int64), max(of - 1, 0))
    top, left = max(height - tall, 0) // 2, max(width - wide, 0) // 2
    out = np.full((height, width, 3), FILL, np.float32)
    out[top : top + tall, left : left + wide] = frame[at(tall, h)[:, None], at(wide, w)][..., ::-1].astype(np.float32) / np.float32(255.0)
    return np.ascontiguousarray(out.transpose(2, 0, 1)) if channels_first else out


def person_score(output: np.ndarray) -> float | None:
    """A10: the best person of an output tensor, at least 0; None where it has no person class or another rank.

    Of three axes the first is the batch, and only its first entry counts. The
    shorter axis has the attributes if both have five or more, else the rows
    if they are five or more.
    """
    if output.ndim == 3 and len(output):
        output = output[0]
    if output.ndim != 2:
        return None
    rows, columns = output.shape
    attributes = output if (rows < columns if min(rows, columns) >= 5 else rows >= 5) else output.T
    n = len(attributes)
    if n < 5:
        return None
    scores = attributes[FIRST] * attributes[SECOND] if n == 6 or n >= 85 else attributes[FIRST]
    return float(np.fmax.reduce(scores, initial=np.float32(0.0)))


def distinct_lines(text: str) -> list[str]:
    """The trimmed lines that aren't empty, each once, in order."""
    return list(dict.fromkeys(x for line in text.splitlines() if (x := line.strip())))
