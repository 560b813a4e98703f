"""Named queries over a data folder, and their SQL where SQL can express them."""

from rootline.plans import events, lineage, reshape, storage

PLANS = (reshape, lineage, storage, events)
