"""Whole procedures: releases, selection, bounds, corrections, and the command line."""
