"""Part of orebody."""
