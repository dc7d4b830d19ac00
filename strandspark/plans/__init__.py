"""Plans: the derived reads relation, named queries and their SQL, workflow scripts."""
