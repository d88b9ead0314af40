"""Training-data operators on texts and entities."""
