"""Registered plans: one per operator of the inventory, with the SQL that checks it."""
