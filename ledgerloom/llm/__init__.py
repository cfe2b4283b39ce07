"""Operators that prepare text for training and evaluating language models; nothing else imports them."""
