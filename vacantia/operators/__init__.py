"""DataFrame-to-DataFrame operators over postings, entities, events and runs."""
