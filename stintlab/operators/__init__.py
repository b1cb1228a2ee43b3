"""DataFrame-to-DataFrame operators over recordings, laps, sectors and channels."""
