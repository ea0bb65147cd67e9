"""Reading technical parameters, parts, quantities and references from free text."""
