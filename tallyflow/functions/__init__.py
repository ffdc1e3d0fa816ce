"""Column functions."""
from tallyflow.functions.columns import (  # noqa: F401
    argmax, clip, draw, draw_below, hash60, reverse_sequence, round_gt_half,
    round_half_even, space_transform,
)
