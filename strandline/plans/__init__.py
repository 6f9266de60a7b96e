"""Named queries over the driver's tables, by subject; each module registers its own."""
