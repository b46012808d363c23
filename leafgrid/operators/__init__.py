"""Relational operators over layout blocks, annotations, prompts and exports."""
