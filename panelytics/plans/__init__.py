"""The question catalogue and the end-to-end job, composed from the operators."""
