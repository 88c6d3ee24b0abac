"""Types of packets and messages."""

PACKETS = "ts timestamp, feed_id string, caplen int, data binary"
QUESTION = "struct<qname:string,qtype:int,qclass:int>"
RECORD = "struct<name:string,type:int,class:int,ttl:bigint,rdata_len:int,rdata:binary,rdata_txt:string,rdata_list:array<string>>"
HEADER = (
    "query_id int, qr boolean, aa boolean, tc boolean, rd boolean, ra boolean, ad boolean, cd boolean, opcode tinyint, rcode tinyint, ans_count int, aut_count int, add_count int"
)
SECTIONS = (
    f"is_valid boolean, is_partial boolean, parse_error string, questions array<{QUESTION}>, answers array<{RECORD}>, authorities array<{RECORD}>, additionals array<{RECORD}>, "
    "has_edns0 boolean, edns0_version int, edns0_max_size int, edns0_do boolean, edns0_rcode int, has_ecs boolean, ecs_family int, ecs_src_scope int, ecs_res_scope int, ecs_addr binary, has_exp_opt boolean"
)
DARKNET = (
    "timestamp long, udp array<struct<port:int,seen_count:long,ips_prob_count:long>>, tcp array<struct<port:int,seen_count:long,ips_prob_count:long>>, "
    "ipid array<struct<ipid:int,seen_count:long,ips_prob_count:long>>, _corrupt_record string"
)
DENAT_QUERY = (
    "timestamp double, client_ip string, ip_ipid int, ip_ttl int, udp_srcport int, dns_qid int, dns_qtype int, dns_qclass int, dns_qname string, dns_edns0 int, dns_edns0_do int, dns_edns0_maxsize int"
)
DENAT_RESPONSE = (
    "timestamp double, client_ip string, ip_ipid int, ip_ttl int, udp_dstport int, dns_qid int, dns_qtype int, dns_qclass int, dns_qname string, first_response_ttl int, dns_edns0 int, dns_edns0_do int, dns_edns0_maxsize int"
)
