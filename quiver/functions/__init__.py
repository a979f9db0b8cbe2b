"""Column -> Column builders: transforms (P), labels (L), losses (E),
segments (G), arrays and sequences (S2 arrays, Q)."""

from quiver.functions import arrays, labels, losses, segments, transforms  # noqa: F401
