"""Blocks of progressive JPEG are transformed a few at a time."""

import tracemalloc

import numpy as np

from cuelake.llm import progressive_jpeg as J


def test_samples_of_many_blocks():
    """Equal to one product over all blocks, and without temporaries of all: products of that size would start threads of the linear algebra
    library, whose waiting took a seventh of the operator's CPU time."""
    x = np.random.default_rng(1).integers(-128, 128, (20_001, 64)).astype(np.int32)
    f = x.reshape(-1, 8, 8).astype(np.float64)
    want = np.clip(np.floor(np.einsum("bvu,vy,ux->byx", f, J._COS, J._COS, optimize=True) / (1 << 24) + 0.5) + 128, 0, 255).astype(np.int16)
    tracemalloc.start()
    got = J.samples(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.dtype == np.int16 and (got == want).all() and peak < 2 * got.nbytes
    assert J.samples(x[:0]).shape == (0, 8, 8)
