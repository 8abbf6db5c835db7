"""Part of clauseaudit."""
