"""Surveys of volumes whose chunks arrive over time (an extension: nothing that is re-expressed here streams)."""
