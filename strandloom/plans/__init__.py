"""Named query plans over the derived read set."""
